import random

import numpy as np
from pyspark.sql import functions as F

from timberline.llm import language

WORDS = {"aa": "the and that with from this have".split(), "bb": "der die und nicht mit auf ein".split(), "cc": "это как что для она они".split()}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_learns_and_scores_whole_texts(spark):
    rng = random.Random(1)
    rows = [(i, text(name, rng.randrange(3, 60), rng), name, "x") for i, name in enumerate(list(WORDS) * 60)]
    rows += [(1000, None, "aa", "x"), (1001, "", "bb", "x"), (1002, "12 !! 😀", "bb", "x"), (1003, "und nicht " * 30, None, "x"), (None, text("cc", 9, rng), "cc", "x"), (1004, text("aa", 60_000, rng), "aa", "x"), (1005, "THE And ÜBER", "aa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    model = language.train(docs.filter("coalesce(doc_id, 0) % 4 <> 2"), key=F.col("doc_id"))
    assert model[0] == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language.identify(docs, model, keep=["doc_id", "lang"]).collect()}
    assert all(got[i].lang_pred == got[i].lang for i in range(180)) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1003].lang_pred == "bb" and got[None].lang_pred == "cc" and got[1004].lang_pred == "aa"


def test_scores_equal_brute_force():
    rng = random.Random(2)
    matrix = np.log(np.random.default_rng(0).random((1 << 8, 3))).astype(np.float32)
    texts = [text(name, 30, rng) for name in WORDS] + ["", "a", "ab?c", "x" * 5]
    total, _, n = language.score(texts, matrix, 4, 8)
    assert n.tolist() == [sum(len(b) for _, b in language.grams([t], 4, 8)[0]) for t in texts]
    for t, row in zip(texts, total, strict=True):
        want = np.zeros(3)
        for _, bucket in language.grams([t], 4, 8)[0]:
            want += matrix[bucket].astype(float).sum(axis=0)
        assert np.allclose(row, want)
    # no n-gram crosses from one text to the next
    assert sum(len(b) for _, b in language.grams(["ab", "cd"], 2, 8)[0]) == 6


def test_nothing_labelled_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = language.train(docs, key=F.col("doc_id"))
    assert language.identify(docs, model, keep=["doc_id"]).first().lang_pred == "und"
    assert language.identify(docs.limit(0), model, keep=["doc_id"]).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("aa").alias("lang"))
    langs, few = language.train(docs, key=F.col("doc_id"), rows_per_language=100, max_n=1, bits=4)
    assert langs == ["aa"] and few.shape == (16, 1)


def test_counts_equal_brute_force(spark):
    """Training counts against n-grams cut out by hand; ties go to the first name; a language without n-grams stays even."""
    rows = [(1, "Ab1c", "xx"), (2, "ab", "xx"), (3, "ab", "yy"), (4, "12", "zz"), (5, None, "xx"), (6, "ab", None), (None, "ab", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = language.train(docs, key=F.col("doc_id"), max_n=2, bits=10, alpha=0.5)
    assert langs == ["xx", "yy", "zz"]
    # runs of what is no letter are one blank; single blanks are no n-gram
    grams = {"xx": ["a", "b", "c", "ab", "b ", " c", "a", "b", "ab"], "yy": ["a", "b", "ab"], "zz": []}
    for k, name in enumerate(langs):
        want = np.full(1 << 10, 0.5)
        for g in grams[name]:
            h = 0
            for c in g:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % (1 << 64)
            want[h * (0xD1342543DE82EF95 + 2 * len(g)) % (1 << 64) >> 54] += 1
        assert np.allclose(matrix[:, k], np.log(want / want.sum()), atol=1e-6)
    even = ["xx", "yy"], np.repeat(matrix[:, :1], 2, axis=1)
    assert language.identify(docs, even, keep=["doc_id"], max_n=2, bits=10).first().lang_pred == "xx"


def test_groups_of_languages_change_nothing(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, text(name, rng.randrange(1, 9), rng), name) for i, name in enumerate(list(WORDS) * 30)] + [(900, None, None), (901, "??", "aa")], "doc_id long, text string, lang string")
    one, parts = language.train(docs, key=F.col("doc_id")), language.train(docs, key=F.col("doc_id"), most_languages=2)
    assert [m[0] for m in parts] == [["aa", "bb"], ["cc"]]
    a, b = ({r.doc_id: r for r in language.identify(docs, m, keep=["doc_id"], fit_out="fit").collect()} for m in (one, parts))
    assert all(a[k].lang_pred == b[k].lang_pred and abs(a[k].score - b[k].score) < 1e-9 and abs(a[k].fit - b[k].fit) < 1e-9 for k in a) and len(a) == len(b) == 92


def test_fit_tells_an_unlearned_script(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, text(name, 40, rng), name) for i, name in enumerate(["aa", "bb"] * 60)], "doc_id long, text string, lang string")
    model = language.train(docs, key=F.col("doc_id"))
    other = spark.createDataFrame([(1, text("cc", 40, rng)), (2, text("aa", 40, rng)), (3, "")], "doc_id long, text string")
    fit = {r.doc_id: (r.score, r.fit) for r in language.identify(other, model, keep=["doc_id"], fit_out="fit").collect()}
    assert fit[1][0] > 0.5 and fit[1][1] < 0.2 and fit[2][1] > 0.9 and fit[3] == (0.0, 0.0)
