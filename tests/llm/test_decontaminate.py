import re

from timberline.llm import decontaminate


def brute(text, items, width=10):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    hit, ids = set(), set()
    for item, t in items:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        n = min(width, len(w))
        if not n:
            continue
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                if item is not None:
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short-item, ÉTÉ"), (3, None), (4, " ... "), (None, "nameless words here"), (10, "one two three four five six seven eight nine ten")]
LONG = "x1 " * 60_000 + "one two three four five six seven eight nine ten" + " y2" * 60_000
TEXTS = [None, "", "!!", "ONE two, three four five six seven eight nine TEN eleven", "a short item ÉTÉ b", "short item été", "nameless words here", LONG, LONG, "one two three", "five\nsix one two three four five six seven eight nine ten eleven twelve thirteen"]


def test_equals_brute_force_and_more_passes_change_nothing(spark):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string, items int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for shard in (32 << 20, 40):
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, keep=["doc_id"], shard_bytes=shard).collect()}
        for i, t in enumerate(TEXTS):
            assert (got[i].n_words, sum(e - b for b, e in got[i].spans), got[i]["items"]) == brute(t, ITEMS), (i, shard)


def test_removal(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 5, 9]
    plain = docs.drop("spans")
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(plain, bench, mode="spans").collect()}
    assert cut[4] == "a  b" and cut[5] == "short item été" and cut[0] is None and brute(cut[7], ITEMS)[1] == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, bench, keep=["doc_id"]).count() == 0
    assert decontaminate.decontaminate(spark.createDataFrame([(1, "one")], docs.schema), bench).count() == 1
