"""A pretraining pipeline of five operators, each stage over all that the one before kept.

Stages read and return the columns of ``documents``; between stages the rows are
written as Parquet in the shared folder. The last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import decontaminate, jaccard, language, pack, pii
from timberline.llm.cluster import materialize, prepare, table
from timberline.llm.queries import DEMO_KEY, tokenizer_path

#: A document without a letter goes, and one of whose language the model is less sure than this.
LEAST_SCORE = 0.5
#: And one that fits its language worse than this: texts of the languages have 0.7 and more, one in a script that no language has next to 0.
LEAST_FIT = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones have; with no labelled one nothing stays."""
    prepare(spark)
    model = language.train(docs, key=F.col("doc_id"))
    names = ("__language", "__score", "__fits")
    found = language.identify(docs, model, keep=docs.columns, lang_out=names[0], score_out=names[1], fit_out=names[2])
    return found.filter((F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE) & (F.col(names[2]) >= LEAST_FIT)).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: that of the least doc_id."""
    prepare(spark)
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    prepare(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars is that of the new text."""
    prepare(spark)
    found = pii.pseudonymise(docs, DEMO_KEY)
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    prepare(spark)
    return pack.pack(docs, tokenizer_path(), max_tokens=1024, end_id=2, ids="crc32")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]

#: Hashed n-gram models, keyed draws and byte-level BPE are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
