"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import decontaminate, fingerprint, jaccard, language, pack, pii, repeats, shard, urls, warc
from timberline.llm.cluster import materialize, prepare, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language.train(docs.filter(part != 2), key=F.col("doc_id"))
    found = language.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: A key for tests and demonstrations; real ones come from a secret store and are passed to ``pii.pseudonymise``.
DEMO_KEY = b"timberline demonstration key"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated"))


OP4_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
    FROM items, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
places AS (
    SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
    FROM words, (SELECT DISTINCT k FROM windows) AS ks, unnest(range(1, len(w) - k + 2)) AS r(i)),
hits AS (SELECT doc_id, i, p.k, item_id FROM places AS p JOIN windows AS v ON p.k = v.k AND p.win = v.win),
covered AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hits) AS h, unnest(range(i, i + k)) AS r(j) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op5_block_anchor_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.deduplicate(table(spark, sf_dir, "documents"), width=13, block=7)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS win FROM words, unnest(range(1, len(w) - 11)) AS r(i)),
least_doc AS (SELECT win, min(doc_id) AS d FROM windows GROUP BY win),
gone AS (
    SELECT DISTINCT doc_id, j FROM windows AS v JOIN least_doc AS l USING (win), unnest(range(i, i + 13)) AS r(j) WHERE l.d < doc_id),
kept AS (
    SELECT doc_id, count(*) FILTER (g.j IS NOT NULL) AS n_removed, coalesce(string_agg(w[p.j], ' ' ORDER BY p.j) FILTER (g.j IS NULL), '') AS kept
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM words) AS p LEFT JOIN gone AS g USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), tokenizer_path(), max_tokens=1024, end_id=2, ids="crc32")


def op7_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.shards(table(spark, sf_dir, "documents"), leaves=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(warc.write_archives(warc.plan(table(spark, sf_dir, "pages"))), "warc", **warc.FILE_OPTIONS)
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT h, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM d LEFT JOIN g USING (h)
"""


def op9_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op9(spark, sf_dir)


def paragraph_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.paragraph_likeness(spark, sf_dir)


#: The given host and path rules, as (verdict, rule).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs that a given rule judges are the labelled ones; what is mined from them judges the others."""
    parts = urls.split(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])
    return urls.judged(parts, keep=["page_id", "host", "path", "rule"])


def _shipped(query):
    """The query, in a prepared session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_block_anchor_repeats": op5_block_anchor_repeats,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_kd_tree_sharding": op7_kd_tree_sharding,
    "op8_zstd_warc": op8_zstd_warc,
    "op9_multiset_fingerprints": op9_multiset_fingerprints,
    "op10_url_rules": op10_url_rules,
    "paragraph_likeness": paragraph_likeness,
}
QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}

ORACLE_SQL = {
    "op4_benchmark_decontamination": OP4_SQL,
    "op5_block_anchor_repeats": OP5_SQL,
    "op8_zstd_warc": OP8_SQL,
    "op9_multiset_fingerprints": fingerprint.SQL,
}
