import io
import json
import os
import random
import shutil
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from timberline.__main__ import main
from timberline.functions import masking
from timberline.operators import corpus, mining
from timberline.plans import ingest, plugins, settings
from timberline.sources import files, segments
from timberline.streaming import mine as streaming


def events(spark, ids):
    rows = [(f"s{i % 2}", i, datetime(2024, 1, 1 + i // 10), f"word{i % 3} line {i}") for i in ids]
    df = spark.createDataFrame(rows, "stream_id string, source_offset long, time timestamp_ntz, raw string")
    return df.withColumn("tokens", F.split("raw", " "))


def test_segments(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path / "store"))
    assert store.read()[0] is None and [store.seal(events(spark, range(10 * k, 10 * k + 10))) for k in range(4)] == [0, 1, 2, 3]
    assert store.seal(events(spark, range(3)), segment=2) == 2 and store.read()[0].count() == 40
    rows, coverage = store.read(begin=datetime(2024, 1, 2), end=datetime(2024, 1, 3))
    assert coverage["segments"] == [1, 2] and rows.count() == 20 and not coverage["partial"]
    rows, coverage = store.read(stream="s1", offset=25)
    assert coverage["segments"] == [2] and rows.first().raw == "word1 line 25"
    assert {r.stream_id: r.source_offset for r in store.cursor().collect()} == {"s0": 38, "s1": 39}
    assert sorted(r.index_time for r in store.read(stream="s0")[0].filter("segment_id = 1").collect()) == [0, 1, 2, 3, 4]
    store.index_terms()
    assert store.read(terms=["37"])[1]["segments"] == [3]
    new = store.compact([0, 1])
    assert new == 4 and store.read()[0].count() == 40 and store.verify() == []
    # a damaged segment is set aside, the others open
    folder = tmp_path / "store/data/segment_id=3"
    shutil.rmtree(folder)
    events(spark, range(30, 39)).withColumn("index_time", F.lit(0).cast("long")).write.parquet(str(folder))
    assert store.verify() == [3] and store.read()[0].count() == 30 and store.read()[1]["partial"]
    assert store.evict(datetime(2024, 1, 3)) == [4] and store.read()[0].count() == 10


def test_terms_find_every_event_after_seal_and_compact(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path))
    plain = events(spark, range(20, 30)).drop("tokens")
    for part, k in ((events(spark, range(10)), 0), (events(spark, range(10, 20)), 1), (plain, 2), (events(spark, range(30, 40)), 3)):
        store.seal(part, k)
    hits = lambda: sorted(r.source_offset for r in store.read(terms=["word1", "line"])[0].filter("raw like 'word1 %'").collect())
    want = [i for i in range(40) if i % 3 == 1 and not 20 <= i < 30]
    rows, coverage = store.read(terms=["word1", "line"])
    assert coverage["segments"] == [0, 1, 2, 3] and hits() == want and store.read(terms=["37"])[1]["segments"] == [2, 3]
    assert store.read(terms=["nosuch"])[1]["segments"] == [2]
    store.compact([0, 1])
    assert hits() == want and store.read(terms=["word1"])[1]["segments"] == [2, 3, 4] and store.read()[0].count() == 40
    store.compact([2, 4])
    assert store.read()[0].count() == 40 and store.read(terms=["15"])[1]["segments"] == [5]


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (segments.Store(spark, str(tmp_path)) for _ in range(2))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda x: x[0].seal(events(spark, range(10 * x[1], 10 * x[1] + 10)), x[1]), [(one, 0), (two, 1), (one, 2), (two, 3)]))
    assert one.read()[0].count() == 40 and one.manifest().select("segment_id").distinct().count() == 4
    fs, claim = one._fs(f"{tmp_path}/claims/v{one._version() + 1}")
    fs.createNewFile(claim)
    with pytest.raises(TimeoutError):
        one._swap(lambda m: m, patience=0.1)


def test_missing_segment_is_partial(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path))
    for k in range(2):
        store.seal(events(spark, range(10 * k, 10 * k + 10)))
    shutil.rmtree(tmp_path / "data/segment_id=1")
    rows, coverage = store.read()
    assert rows.count() == 10 and coverage["missing"] == [1] and coverage["partial"]


def test_file_offsets(spark, tmp_path):
    text = "first\r\né second\n\nlast without end"
    (tmp_path / "a.log").write_bytes(text.encode())
    got = files.read_files(spark, str(tmp_path)).orderBy("source_offset").collect()
    assert [(r.source_offset, r.raw) for r in got] == [(0, "first"), (7, "é second"), (17, ""), (18, "last without end")]
    assert [r.raw for r in files.read_files(spark, str(tmp_path), start={"a.log": 17}).orderBy("source_offset").collect()] == ["", "last without end"]
    assert [(r.source_offset, r.raw) for r in files.read_stdin(spark, source=io.StringIO("x\nyé\nz")).collect()] == [(0, "x"), (2, "yé"), (6, "z")]
    assert set(files.raw_events(files.read_files(spark, str(tmp_path))).columns) >= {"raw", "severity", "template_id", "fingerprint"}


def test_journal_and_generations(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"MESSAGE":"up","PRIORITY":"3","_SYSTEMD_UNIT":"x.service","__REALTIME_TIMESTAMP":"5"}\n')
    assert files.read_journal(spark, str(tmp_path / "j.json")).first().asDict() == {"stream_id": "x.service", "generation": 0, "source_offset": 5, "raw": "up", "priority": "3"}
    shots = spark.createDataFrame([("a", 1, "i1", 10), ("a", 2, "i1", 20), ("a", 3, "i1", 5), ("a", 4, "i2", 9)], "stream_id string, seen_at int, identity string, size int")
    assert [r.generation for r in files.generations(shots).orderBy("seen_at").collect()] == [0, 0, 1, 2]


def test_docker_and_retries(spark, tmp_path):
    (tmp_path / "c1.log").write_text('{"log":"up\\n","stream":"stderr","time":"2024-01-01T00:00:01.5Z"}\n')
    r = files.read_docker(spark, str(tmp_path / "c1.log")).first()
    assert (r.stream_id, r.source_offset, r.raw) == ("c1.log:stderr", 1_704_067_201_500_000, "up")
    pauses, calls, dead = [], [], []

    def odd():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "done"

    assert plugins.with_retries(odd, jitter=lambda: 0.5, sleep=pauses.append) == "done" and pauses == [0.1, 0.2]
    assert plugins.with_retries(lambda: 1 / 0, tries=2, sleep=lambda s: None, dead_letter=dead.append) is None and len(dead) == 1


def tail(spark, folder, out, marks, **options):
    """All that is there now, as one run of the query; the rows so far."""
    files.register(spark)
    q = spark.readStream.format("line_tail").options(path=str(folder), **options).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted((r.generation, r.source_offset, r.raw) for r in spark.read.schema(files.RAW).parquet(out).collect())


def test_tail_with_rotation(spark, tmp_path):
    folder, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()
    go = lambda: tail(spark, folder, out, marks)
    (folder / "a.log").write_text("one\ntwo\nhal")
    assert go() == [(0, 0, "one"), (0, 4, "two")]
    with open(folder / "a.log", "a") as f:
        f.write("f\nthree\n")
    assert go() == [(0, 0, "one"), (0, 4, "two"), (0, 8, "half"), (0, 13, "three")]
    # renamed with an unread line, and a new file in its place: both are the stream a.log
    with open(folder / "a.log", "a") as f:
        f.write("last\n")
    os.rename(folder / "a.log", folder / "a.log.1")
    (folder / "a.log").write_text("fresh\n")
    rows = go()
    assert rows[4:] == [(0, 19, "last"), (1, 0, "fresh")] and {r.stream_id for r in spark.read.schema(files.RAW).parquet(out).collect()} == {"a.log"}
    # cut off, and grown again beyond the old end
    with open(folder / "a.log", "r+") as f:
        f.truncate(0)
        f.write("again and longer than before\n")
    assert go()[6:] == [(2, 0, "again and longer than before")] and len(go()) == 7


def test_tail_takes_lines_longer_than_a_piece(spark, tmp_path):
    folder, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()
    lines = ["x" * 5000, "short", "", "y" * 300, "é" * 700, "end"]
    (folder / "a.log").write_bytes("\n".join(lines).encode() + b"\n" + b"bad \xff bytes\r\nrest")
    got = tail(spark, folder, out, marks, maxBytesPerTask=64)
    assert [r[2] for r in got] == [*lines, "bad \ufffd bytes"] and [r[1] for r in got][:3] == [0, 5001, 5007]


def test_one_reader_sees_backlog_then_what_is_appended(spark, tmp_path):
    """Offsets of one running reader: no gap and no overlap where the backlog ends and the tail begins."""
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(200)))
    reader, start, seen = files._TailReader(str(tmp_path), 256), {}, []
    for k in range(4):
        end = reader.latestOffset()
        seen += [x for piece in reader.partitions(start, end) for x in reader.read(piece)]
        reader.commit(end)
        start = end
        with open(tmp_path / "a.log", "a") as f:
            f.write(f"more {k}\n")
    assert [x[3] for x in seen] == [f"line {i}" for i in range(200)] + ["more 0", "more 1", "more 2"]
    assert all(b[2] == a[2] + len(a[3]) + 1 for a, b in zip(seen, seen[1:], strict=False))


def test_files_in_many_splits(spark, tmp_path):
    rng = random.Random(3)
    lines = ["".join(rng.choices("abc é\r", k=rng.randrange(0, 90))) for _ in range(4000)]
    (tmp_path / "b c+d.log").write_bytes("\n".join(lines).encode() + b"\n\xff\xfe bad\n")
    (tmp_path / "empty.log").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = files.read_files(spark, str(tmp_path)).orderBy("source_offset").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    at, want = 0, []
    for x in lines:
        want.append((at, x.removesuffix("\r")))
        at += len(x.encode()) + 1
    assert [(r.source_offset, r.raw) for r in got] == [*want, (at, "\ufffd\ufffd bad")] and {r.stream_id for r in got} == {"b c+d.log"}


def lines_of(spark):
    raw = [f'10.0.0.{i} - - [10/Oct/2024:13:55:36 +0000] "{m} /p/{i} HTTP/1.1" 200 {i}' for i, m in enumerate(["GET", "POST", "GET", "DELETE"])]
    return [("nginx-access", i + 1, x) for i, x in enumerate(raw)], ["GET", "POST", "GET", "DELETE"]


def test_corpus(spark, tmp_path):
    rows, gids = lines_of(spark)
    root = tmp_path / "corpus"
    (root / "n").mkdir(parents=True)
    (root / "manifest.toml").write_text('[[format]]\nid = "nginx-access"\npath = "n"\nlines = 4\n')
    (root / "n/input.log").write_text("\n".join(r[2] for r in rows) + "\n")
    (root / "n/labels.jsonl").write_text("\n".join(json.dumps({"line": i + 1, "template_gid": g}) for i, g in enumerate(gids)))
    (root / "n/templates.json").write_text(json.dumps({m: f'<IP> - - <TS> "{m} <PATH> HTTP/1.1" <NUM> <NUM>' for m in ("GET", "POST", "DELETE")}))
    lines, labels, templates = files.load_corpus(spark, str(root))
    labels = labels.select("format_id", "line", "template_gid")
    corpus.check(lines, labels, templates)
    got = corpus.assignments(lines, labels, templates)
    assert corpus.accuracy(got).first().pa_exact == 1.0 == corpus.accuracy(got, by_format=False).first().pa_grouping
    assert corpus.template_delta(got).first().delta == 0 and corpus.deterministic(lines)
    assert corpus.accuracy(got.limit(0), by_format=False).first().pa_exact == 1.0
    with pytest.raises(corpus.UnknownTemplate):
        corpus.check(lines, labels, templates.filter("template_gid <> 'GET'"))
    with pytest.raises(corpus.MissingLabel):
        corpus.check(lines, labels.filter("line > 1"), templates)
    assert corpus.set_hash(got, "mined") == corpus.set_hash(templates)
    (root / "n/labels.jsonl").write_text("")
    with pytest.raises(ValueError, match="0 labels"):
        files.load_corpus(spark, str(root))


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", i, f"k {i % 2} a b {w} tail".split()) for i, w in enumerate(["x", "y", "x", "z", "x", "q"] * 5)]
    df = spark.createDataFrame(rows, "stream_id string, source_offset long, masked array<string>")
    source = str(tmp_path / "in")
    for k in range(3):
        df.filter(F.floor(F.col("source_offset") / 10) == k).coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    # files come in order of time, so offsets do too
    q = streaming.mine_stream(live).writeStream.format("memory").queryName("mined").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.source_offset: (r.pattern, r.version, r.seen) for r in spark.table("mined").collect()}
    want = {r.source_offset: (r.pattern, r.version, r.seen) for r in mining.mine_online(df).collect()}
    assert {k: v[2] for k, v in got.items()} != {} and len(got) == 30
    assert {v[0] for v in got.values()} == {v[0] for v in want.values()}


def test_stream_lateness_and_sealing(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([("s", 0, t(10)), ("s", 1, t(5)), ("s", 2, None), ("s", 3, t(30)), ("s", 4, t(1))], "stream_id string, source_offset long, event_time timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streaming.lateness_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("late").start()
    q.processAllAvailable()
    q.stop()
    assert {r.source_offset: r.lateness for r in spark.table("late").collect()} == {0: "on_time", 1: "late", 2: None, 3: "on_time", 4: "very_late"}
    rows = events(spark, range(20))
    rows.coalesce(1).write.parquet(str(tmp_path / "ev"))
    store = segments.Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # a second run finds nothing new
        streaming.seal_batches(store, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev")), str(tmp_path / "marks")).awaitTermination()
    assert store.read()[0].count() == 20 and store.manifest().select("segment_id").distinct().count() == 1


def test_ingest(spark):
    lines = spark.createDataFrame([("s", 0, "<131>1 2024-10-10T13:55:36.123Z h a - - - mail a@b.org ERROR"), ("s", 1, ""), ("s", 2, "x" * 70_000), ("s", 3, None)], "stream_id string, source_offset long, raw string")
    got = {r.source_offset: r for r in ingest.ingest(lines).collect()}
    assert got[0].severity == "error" and "[REDACTED:email]" in got[0].raw and got[0].template_id == 0 and got[0].fingerprint is not None
    assert [got[i].parse_status for i in (1, 2, 3)] == ["empty", "too_long", "empty"] and all(got[i].template_id is None and got[i].fingerprint is None for i in (1, 2, 3))
    assert got[0].attributes[-1].key == "severity_source" and masking.MOST_BYTES == 65_536


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('state_dir = "/x"\n[mining]\ndepth = 6\n[[streams]]\nid = "a"\nfloor = "error"\n')
    got = settings.load(str(tmp_path / "c.toml"), env={"TIMBERLINE_MINING__DEPTH": "7", "OTHER": "1"}, flags={"mining": {"threshold": 0.6}})
    assert got["mining"] == {"depth": 7, "threshold": 0.6, "most_templates": 10_000, "stable_at": 5} and got["state_dir"] == "/x"
    assert settings.streams(got)[0].floor == "error"
    told = settings.load(env={}, flags={"streams": [{"id": "a.log", "format": "nginx-access", "time_formats": ["access_log"]}, {"id": "b.log", "mining": {"depth": 2}}, {"id": "c.log"}]})
    assert settings.mining_params(told).depths == {"a.log": 5, "b.log": 2} and settings.times_by_stream(told) == {"a.log": ["access_log"]}
    for bad in ({"nosuch": 1}, {"mining": {"depth": 0}}, {"streams": [{"id": "a"}, {"id": "a"}]}, {"streams": [{"id": "a", "mode": "odd"}]}, {"streams": [{"id": "a", "time_formats": ["nosuch"]}]}, {"redaction": [{"class": "x", "pattern": "("}]}, {"streams": [{"id": "a", "api_key": "x"}]}):
        with pytest.raises(settings.ConfigError):
            settings.load(env={}, flags=bad)


def test_plugins_bus_and_budgets(spark, tmp_path):
    class Good:
        def enrich(self, events):
            return events.withColumn("x", F.lit(1))

    class Bad(Good):
        def enrich(self, events):
            raise RuntimeError("no")

    r = plugins.Registry()
    for name, p in (("good", Good()), ("bad", Bad())):
        r.register(name, "Enricher", p)
        r.validate(name)
        r.activate(name)
    out = r.apply("Enricher", lambda p: p.enrich(spark.range(2)).count())
    assert out == {"good": 2} and r.held["bad"]["state"] == "isolated" and r.apply("Sink", lambda p: p) == {}
    r.register("odd", "Sink", object())
    with pytest.raises(TypeError):
        r.validate("odd")
    bus, seen = plugins.Bus(), []
    stop = bus.subscribe("a", seen.append)
    bus.subscribe("a", lambda e: 1 / 0)
    assert bus.publish("a", {"x": 1}) == 1 and seen == [{"x": 1}] and bus.failed
    stop()
    assert bus.publish("a", {}) == 0
    assert plugins.evaluate({"ingest_latency_p99_ms": 5, "indexing_lines_per_s": 10, "query_complete_ms": 1}, {"ingest_latency_p99_ms": 6, "indexing_lines_per_s": 11}) == {"ingest_latency_p99_ms": "exceeded", "indexing_lines_per_s": "within", "query_complete_ms": "unknown"}
    plugins.FileSink(str(tmp_path / "s")).emit(spark.range(3))
    plugins.ChannelSink(seen.append).emit(spark.range(2))
    assert spark.read.json(str(tmp_path / "s")).count() == 3 and seen[-1] == {"id": 1}


def test_command_line(spark, tmp_path, capsys):
    assert main(["version"]) == 0 and main(["validate"]) == 0 and main(["query", str(tmp_path / "s"), "nosuch = 1"]) == 2
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("<131>1 2024-10-10T13:55:36.123Z h a - - - down\nplain line\n")
    store = str(tmp_path / "store")
    assert main(["ingest", str(tmp_path / "logs"), store]) == 0 and main(["query", store, "severity >= error"]) == 0 and main(["status", store]) == 0
    out = capsys.readouterr().out
    assert '"raw": "<131>1' in out and '"n": 2' in out and os.path.exists(store)
