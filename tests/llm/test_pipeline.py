"""Every stage against a brute-force version, on a small fixture; and the whole run on the smallest tables."""

import random

from test_decontaminate import brute as brute_hits
from test_jaccard import brute as brute_classes
from tokenizers import Tokenizer

import corpus_pipeline
from timberline.llm import pii
from timberline.llm.queries import tokenizer_path

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and that with this from have were which their".split(), "de": "der die und nicht mit auf ein sich werden auch".split()}


def fixture():
    rng = random.Random(4)
    texts = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        texts.append((" ".join(rng.choice(WORDS[lang]) + (rng.choice("abcdef") if rng.random() < 0.5 else "") for _ in range(rng.randrange(8, 200))), lang))
    texts += [(texts[3][0], "en"), (texts[4][0] + " more", "en"), (texts[5][0].upper(), "de"), ("12345 !!", "en"), (None, None), ("", "en")]
    fresh = " ".join(rng.choice(WORDS["en"]) + rng.choice("ghij") for _ in range(60))
    texts += [(fresh + " alpha beta gamma delta epsilon zeta eta theta iota kappa", "en"), ("write to jane.roe@mail.example.org or 10.1.2.3 and " + texts[9][0], "en")]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]


BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")]


def test_stages_equal_brute_force(spark, tmp_path):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, rows = spark.createDataFrame(fixture(), KIND), fixture()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "best_fit_packing":
            exact = Tokenizer.from_file(tokenizer_path())
            pieces = out.toPandas()
            assert pieces.groupby("doc_id").length.sum().to_dict() == {r[0]: len(exact.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows}
            assert pieces.groupby("sequence_id").length.sum().max() <= 1024
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = sorted(tuple(r) for r in docs.collect())
        if name == "language_id":
            want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
        elif name == "ngram_jaccard_join":
            least = {c[0]: c[1] for c in brute_classes([r[:2] for r in rows])}
            want = [r for r in rows if least[r[0]] == r[0]]
        elif name == "benchmark_decontamination":
            want = [r for r in rows if brute_hits(r[1], BENCH)[1] == 0]
        else:
            want = None
            assert [r[0] for r in got] == [r[0] for r in rows]
            for new, old in zip(got, rows, strict=True):
                assert new[4] == len(new[1]) and (new[1] == old[1]) == (not pii.find(old[1]))
                assert not any(old[1][a:b] in new[1] for a, b, _, _ in pii.find(old[1]))
        assert want is None or got == want, name
        assert len(got) < len(rows) or name == "pii_surrogates"
        rows = got


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "pii_surrogates", "best_fit_packing"]
