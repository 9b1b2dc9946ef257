"""What queries move and hold as tables grow."""

import os
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberline import catalog_io
from timberline.functions import scratch
from timberline.operators import corpus, mining
from timberline.plans import lql
from timberline.sources import files
from timberline.streaming import mine as streaming

LINES = "stream_id string, source_offset long, masked array<string>"
TEMPLATES = "stream_id string, template_id long, occurrence_count long, version int, pattern string"


def test_only_templates_that_share_a_half_are_spread(spark):
    long = [f"w{i}" for i in range(3_000)]
    other = [*long[:2_999], "end"]
    alone = [" ".join(f"{k}x{i}" for i in range(3_000)) for k in range(5)]
    rows = [("s", k, 5, 1, p) for k, p in enumerate([" ".join(long), " ".join(other), *alone])]
    templates = spark.createDataFrame(rows, TEMPLATES)
    assert sorted((r.template_id, r.side) for r in mining.halves(templates).collect()) == [(0, 0), (1, 0)]
    assert [(r.template_id, r.survivor, r.position, r.version) for r in mining.merge_candidates(templates).collect()] == [(1, 0, 2_999, 2)]


def test_merging_finds_every_pair_at_every_position(spark):
    import itertools

    patterns = [" ".join(p) for n in (1, 2, 3, 4) for p in itertools.product("ab", repeat=n)]
    templates = spark.createDataFrame([("s", k, 1 + k % 3, 1, p) for k, p in enumerate(patterns)], TEMPLATES)
    want = {}
    for k, p in enumerate(patterns):
        p = p.split()
        for at in range(len(p)):
            same = [j for j, q in enumerate(patterns) if len(q.split()) == len(p) and all(a == b for i, (a, b) in enumerate(zip(q.split(), p, strict=True)) if i != at)]
            best = min(same, key=lambda j: (-(1 + j % 3), j))
            if best != k:
                want[k] = min(want.get(k, (best, at)), (best, at))
    assert {r.template_id: (r.survivor, r.position) for r in mining.merge_candidates(templates).collect()} == want


def test_text_of_lines_that_stand_alone_is_not_folded(spark):
    rows = [("s", k, [f"a{k}", "b", "c", "d", "e"]) for k in range(50)] + [("s", 100 + k, ["m", "n", "o", "p", x]) for k, x in enumerate("xyx")]
    mined = mining.Mined(spark.createDataFrame(rows, LINES))
    # versions are kept of the one bucket with two lines
    assert mined.patterns.select("created").distinct().count() == 1
    assert {r.pattern for r in mined.registry().collect()} == {f"a{k} b c d e" for k in range(50)} | {"m n o p <*>"}
    wide = {r.source_offset: (r.pattern, r.version, r.seen) for r in mined.events().filter("source_offset >= 100").collect()}
    assert wide == {100: ("m n o p x", 1, 1), 101: ("m n o p <*>", 2, 2), 102: ("m n o p <*>", 2, 3)}


def test_chosen_rows_are_the_same_with_and_without_a_broadcast(spark):
    held = spark.range(0, 1_000, 1, 7).withColumnRenamed("id", "__id").withColumn("t", F.col("__id") * 2)
    ids = held.filter("__id % 63 < 2 or __id = 999").select(F.col("__id").alias("k"))
    want = sorted(r.k for r in ids.collect())
    for most in (1 << 20, 0):
        assert sorted(r["__id"] for r in mining.chosen(held, ids, most_bytes=most).collect()) == want


def test_fuzzy_spans_equal_the_lazy_expression_and_long_misses_end(spark):
    texts = ["num", "n u n u m", "mun", "", "x\nnew\nsummer", "NUM", "nn uu mm", "n" * 9 + "um", "unm"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {t: len(m[0]) for t in texts if (m := re.search("(?s)n.*?u.*?m", t.lower()))}
    assert {r.t: r.score for r in lql.fuzzy_rank(rows, "num", column="t").collect()} == want
    # cubic by backtracking
    assert lql.fuzzy_rank(spark.createDataFrame([("nu" * 20_000,)], "t string"), "num", column="t").collect() == []
    assert {r.score for r in lql.fuzzy_rank(rows, "", column="t").collect()} == {0}


def test_a_file_is_written_in_pieces_and_put_together_in_order(spark, tmp_path):
    rows = spark.range(0, 5_000, 1, 6).select((5_000 - F.col("id")).alias("at"), F.concat(F.lit("line "), 5_000 - F.col("id")).alias("raw"))
    files.write_file(rows, f"file://{tmp_path}/x/access.log", order="at", line="raw")
    with open(tmp_path / "x" / "access.log") as f:
        assert f.read() == "".join(f"line {k}\n" for k in range(1, 5_001))
    assert files.local_path("file:///a/b") == "/a/b" and files.local_path("file:/a/b") == "/a/b" and files.local_path("/a/b:c") == "/a/b:c"
    with pytest.raises(ValueError, match="mounts"):
        files.local_path("viewfs://in/a")


def test_tail_lines_reads_below_the_shared_folder(spark, tmp_path, monkeypatch):
    """Executors need not see the driver's temporary folder."""
    made = []
    monkeypatch.setattr(scratch, "folder", lambda s, tag: made.append(f"file://{tmp_path}/{tag}-{len(made)}") or made[-1])
    events = spark.range(300).select(F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("click").alias("event_type"))
    os.makedirs(tmp_path / "in")
    events.write.parquet(f"{tmp_path}/in/events.parquet")
    got = sorted((r.source_offset, r.raw) for r in catalog_io.catalog.QUERIES["tail_lines"](spark, f"{tmp_path}/in").collect())
    assert len(got) == 300 and got[0][0] == 0 and all(b == a + len(x) + 1 for (a, x), (b, _) in zip(got, got[1:], strict=False))
    assert any(os.path.exists(f"{p.removeprefix('file://')}/access.log") for p in made)


@pytest.mark.parametrize("run", [7, 50, 10_000])
def test_rows_of_a_key_come_in_order_in_bounded_frames(run):
    import random

    rng = random.Random(run)
    rows = [(rng.randrange(60), k) for k in range(1_000)]
    batches = [pd.DataFrame(rows[at : at + 90], columns=["source_offset", "k"]) for at in range(0, 1_000, 90)]
    got = list(streaming.in_order(iter(batches), run=run, piece=5))
    assert [tuple(r) for f in got for r in f.itertuples(index=False)] == sorted(rows, key=lambda r: r[0])
    assert list(streaming.in_order(iter([]), run=run)) == []


def _packed_rows(events):
    """Pieces (line, fingerprint, offsets) of events (offset, line), some lines in several."""
    of = {}
    for at, (offset, line) in enumerate(events):
        of.setdefault((line, at // 70), []).append(offset)
    return [(line, int(line[1:]), np.array(offsets, np.int64).tobytes()) for (line, _), offsets in of.items()]


@pytest.mark.parametrize(("run", "most_bytes"), [(7, 1 << 20), (90, 1 << 20), (10_000, 40), (10_000, 1 << 20)])
def test_packed_offsets_come_in_order_in_bounded_frames(run, most_bytes):
    rng = random.Random(run)
    events = [(rng.randrange(600), f"l{rng.randrange(30)}") for _ in range(1_000)]
    rows = _packed_rows(events)
    batches = [pd.DataFrame(rows[at : at + 13], columns=["line", "fingerprint", "offsets"]) for at in range(0, len(rows), 13)]
    frames = list(streaming.turns(iter(batches), run=run, most_bytes=most_bytes, piece=5, frame=20))
    got = [(int(o), lines[c]) for offsets, codes, lines, _ in frames for o, c in zip(offsets, codes, strict=True)]
    assert [o for o, _ in got] == sorted(o for o, _ in events) and sorted(got) == sorted(events)
    assert all(sorted(set(codes.tolist())) == list(range(len(lines))) and [int(x[1:]) for x in lines] == prints for _, codes, lines, prints in frames)
    assert list(streaming.turns(iter([]), run=run)) == []


@pytest.mark.parametrize(("seed", "most", "values", "threshold"), [(1, 10_000, 3, 0.8), (1, 10_000, 30, 0.4), (1, 6, 5, 0.8), (1, 2, 3, 0.6), (1, 2, 30, 0.99)])
def test_events_counted_at_once_equal_events_in_turn(seed, most, values, threshold):
    """Templates that widen over others' lines, that turn cold, and long runs of known lines."""
    import json

    rng = random.Random(seed)
    events = []
    while len(events) < 6_000:
        words = [tuple(["a", *(f"{rng.randrange(values)}" for _ in range(5))]) for _ in range(rng.randrange(1, 9))]
        events += [words[rng.randrange(len(words))] for _ in range(rng.choice([1, 5, 200]))]
    prints = {x: k for k, x in enumerate(dict.fromkeys(events))}
    plain, bulk = streaming.LiveBucket(1, threshold, most), streaming.LiveBucket(1, threshold, most)
    clears = colds = 0
    for start in range(0, len(events), 500):
        part = events[start : start + 500]
        want = []
        for k, x in enumerate(part):
            t = plain.add(x, prints[x])
            t[4:] = [start + k]
            want.append((t[1], " ".join(t[0]), t[2], t[3]))
            clears, colds = clears + (plain.lost is plain), colds + isinstance(plain.lost, list)
        lines = list(dict.fromkeys(part))
        codes = np.array([lines.index(x) for x in part], np.int32)
        which, seen, spelt = bulk.add_all(np.arange(start, start + len(part)), codes, lines, [prints[x] for x in lines])
        assert [(*spelt[w][1:], s) for w, s in zip(which.tolist(), seen.tolist(), strict=True)] == want
        assert json.dumps(plain.templates) == json.dumps(bulk.templates)
        if start % 1_500 == 0:
            plain.known.clear()
            bulk = streaming.LiveBucket(1, threshold, most, json.loads(json.dumps(bulk.templates)))
    assert clears + colds > 0


def test_packing_keeps_every_event():
    rows = [("s" if k % 3 else None, 4, 2, "x", f"x\x1e{k % 5}", 10_000 - k) for k in range(9_000)]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
    names = [*streaming.KEYS, "line", "source_offset"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 400], strict=True), types, strict=True)], names) for at in range(0, 9_000, 400)]
    got = [r for b in streaming.packed(iter(batches), most=6_000) for r in b.to_pylist()]
    assert all(0 < len(r["offsets"]) <= 8 * streaming.PIECE for r in got) and len(got) < 80
    assert {r["line"]: r["fingerprint"] % 2**64 for r in got} == {f"x\x1e{k}": streaming.fnv.fnv1a(f"x\x1e{k}".encode()) for k in range(5)}
    each = [(r["stream_id"], r["depth"], r["n"], r["prefix"], r["line"], int(o)) for r in got for o in np.frombuffer(r["offsets"], np.int64)]
    assert sorted(each, key=lambda r: r[-1]) == rows[::-1]
    assert list(streaming.packed(iter([]))) == []


def _shuffled_rows(spark):
    """Rows that the session's stages have shuffled so far, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def test_a_stream_of_few_lines_moves_few_rows_to_its_bucket(spark, tmp_path):
    """One bucket's task gets lines with packed offsets, not a row an event."""
    n = 30_000
    rows = spark.range(0, n, 1, 3).select(F.lit("s").alias("stream_id"), F.col("id").alias("source_offset"), F.array(*map(F.lit, "abcd"), (F.col("id") % 3).cast("string")).alias("masked"))
    rows.write.parquet(f"{tmp_path}/in")
    before = _shuffled_rows(spark)
    live = streaming.mine_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
    moved = sum(r for k, r in _shuffled_rows(spark).items() if k not in before)
    got = spark.read.schema(streaming.MINED).parquet(f"{tmp_path}/out").orderBy("source_offset").collect()
    assert [(r.source_offset, r.seen, r.version, r.pattern) for r in got] == [(k, k + 1, min(k + 1, 2), "a b c d <*>" if k else "a b c d 0") for k in range(n)]
    assert 0 < moved < n / 50


def test_two_runs_are_compared_with_all_tasks(spark):
    seen = []

    def miner(lines):
        seen.append(lines.rdd.getNumPartitions())
        return lines.select("format_id", "line", F.col("raw").alias("pattern"), F.lit("g").alias("group"))

    lines = spark.range(50).select(F.lit("f").alias("format_id"), F.col("id").alias("line"), F.lit("x").alias("raw"))
    assert corpus.deterministic(lines, miner)
    assert len(set(seen)) == 2 and min(seen) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = iter("ab")
    assert not corpus.deterministic(lines, lambda x: miner(x).withColumn("pattern", F.lit(next(turns))))


def test_accuracy_of_unparsed_lines_and_of_none(spark):
    kind = "format_id string, line long, template_gid string, expected string, mined string, group string, match boolean"
    rows = [("f", 1, "a", "A", "A", "1", True), ("f", 2, "a", "A", None, None, False), ("f", 3, "b", "B", "B", "2", True), ("g", 1, "c", "C", "D", "1", False)]
    got = {r.format_id: (r.lines, r.pa_exact, r.pa_grouping) for r in corpus.accuracy(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"f": (3, 0.666667, 0.333333), "g": (1, 0.0, 1.0)}
    none = corpus.accuracy(spark.createDataFrame([], kind), by_format=False).first()
    assert (none.lines, none.pa_exact, none.pa_grouping) == (0, 1.0, 1.0)
    delta = {r.format_id: r.delta for r in corpus.template_delta(spark.createDataFrame(rows, kind)).collect()}
    assert delta == {"f": 0, "g": 0}


def test_states_of_templates_move_no_text(spark, tmp_path):
    """They follow from numbers: what is written of the events' text is not read again for them."""
    from timberline import catalog

    spark.createDataFrame([(k, f"a b c d {k} x{k % 3}", "s") for k in range(30)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("evict_cold", "template_lifecycle", "promote_stable"):
        rows = catalog.QUERIES[name](spark, str(tmp_path))
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert rows.count() > 0 and "masked" not in plan and "__of" not in plan and "tokens" not in plan, name


def _shuffled(spark):
    """Bytes that the session's stages have shuffled so far, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_fingerprints_shuffle_less_than_the_text(spark, tmp_path):
    """Fingerprint and pattern are made of tokens that move once, packed."""
    import random

    from timberline import catalog

    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("ghijklmnopqrstuv", k=25)) for _ in range(40)) for _ in range(600)]
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    before = _shuffled(spark)
    rows = catalog.QUERIES["resolve_fingerprints"](spark, str(tmp_path)).collect()
    moved = sum(n for k, n in _shuffled(spark).items() if k not in before)
    assert sorted((r.pattern, r.fingerprint, r.events) for r in rows) == sorted((t, t.replace(" ", "\x1e"), 1) for t in texts)
    assert 0 < moved < sum(map(len, texts))


def test_tokens_come_to_their_events_over_pieces_and_blocks(spark):
    """Blocks cut by batches, lines that do not parse, odd tokens, and blocks of which no row is asked for."""
    texts = [None if k % 11 == 0 else [] if k % 13 == 0 else [f"a{k}", "\x1e", "", "é b", "c" * (k % 50)] for k in range(5_000)]
    rows = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], LINES).repartition(3, "source_offset")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        mined = mining.Mined(rows)
        some = mined.rows.filter("__at % 3 = 0 and (__id % 4096) >= 1024").select("__id", "__at", "stream_id")
        want = sorted(r["__at"] for r in some.collect())
        got = {r["__at"]: (r.stream_id, r.masked) for r in mined.with_masked(some).collect()}
        assert len(want) > 500 and sorted(got) == want and all(v == ("s", texts[k]) for k, v in got.items())
        assert mined.with_masked(some.filter("__at < 0")).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
