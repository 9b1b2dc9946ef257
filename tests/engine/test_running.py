import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from timberline.functions import running
from timberline.operators import insights, mining
from timberline.streaming.mine import Detector, LiveBucket


def test_running_numbers_and_maxima_over_pieces(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k * 7, rng.choice([None, *range(50)])) for k in range(400)] + [("c", -5, 3)]
    df = spark.createDataFrame(rows, "g string, at long, v int").repartition(5)
    for width in (1, 64, 1 << 20):
        got = {r.at: (r.n, r.m) for r in running.greatest_before(running.number(df, ["g"], "at", "n", width=width), ["g"], "at", "v", "m", width=width).collect()}
        seen = {}
        for g, at, v in sorted(rows, key=lambda r: r[1]):
            n, m = seen.get(g, (0, None))
            assert got[at] == (n, m), (g, at, width)
            seen[g] = (n + 1, m if v is None else v if m is None else max(m, v))
    assert running.number(df.limit(0), ["g"], "at", "n").count() == 0


def test_streams_have_depths_of_their_own(spark):
    rows = [(s, k, ["A", "B", "C", "D", w]) for s in ("deep", "flat") for k, w in enumerate("xyx")]
    df = spark.createDataFrame(rows, "stream_id string, source_offset long, masked array<string>")
    got = mining.mine_online(df, mining.Params.of_formats({"deep": "nginx-access", "flat": "json-lines"})).collect()
    assert {r.stream_id: max(x.template_id for x in got if x.stream_id == r.stream_id) for r in got} == {"deep": 1, "flat": 0}


def test_a_line_goes_over_to_an_older_template_that_came_to_cover_it(spark):
    lines = ["p a a x", "p b b x", "p a b x", "p b b x", "p a a x", "p b b x"]
    df = spark.createDataFrame([("s", k, t.split()) for k, t in enumerate(lines)], "stream_id string, source_offset long, masked array<string>")
    got = [(r.template_id, r.pattern) for r in mining.mine_online(df, mining.Params(depth=1, threshold=0.6)).orderBy("source_offset").collect()]
    bucket, want = mining.Bucket(1, 0.6), []
    for k, t in enumerate(lines):
        held = bucket.add(t.split(), k)
        want.append(([x[1] for x in bucket.templates].index(held[1]), " ".join(held[0])))
    assert got == want and len({p for _, p in got}) > 1


def test_live_buckets_equal_plain_ones_and_stay_bounded():
    rng = random.Random(2)
    lines = [["k", *(rng.choice("abc") for _ in range(6))] for _ in range(900)]
    live, plain = LiveBucket(1, 0.6, 10_000), mining.Bucket(1, 0.6)
    for k, t in enumerate(lines):
        a, b = live.add(tuple(t), k), plain.add(list(t), k)
        assert a[:4] == b[:4]
    few = LiveBucket(1, 0.99, 5)
    for k, t in enumerate(lines):
        few.add(tuple(t), k)[4:] = [k]
        assert len(few.templates) <= 5


def test_detection_goes_on_from_batch_to_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    hours = [3, 4, 3, 5, 4, 3, 4, 40, 3, 3]
    rows = [("s", "t", start + timedelta(hours=h, seconds=k)) for h, n in enumerate(hours) for k in range(n)]
    df = spark.createDataFrame(rows, "stream_id string, template_id string, time timestamp")
    told = []
    detector = Detector(spark, str(tmp_path / "counts"), insights.Settings(window="1 hour", min_volume=6), lambda found, batch: told.append((batch, [(r.kind, r.win_start, r.cnt) for r in found.collect()])))
    early = df.filter(F.hour("time") < 7)
    detector.batch(early, 0)
    detector.batch(df.filter(F.hour("time") == 7), 1)
    assert [x for _, x in told] == [[], []]  # the eighth window is still open
    detector.batch(df.filter(F.hour("time") > 7), 2)
    detector.batch(df.filter(F.hour("time") > 7), 2)  # the same batch again counts once
    want = [("spike", start + timedelta(hours=7), 40)]
    assert told[2][1] == want == told[3][1]
    late = spark.createDataFrame([("s", "t", start + timedelta(hours=7, minutes=5))], df.schema)
    detector.batch(late, 3)
    assert told[4][1] == [("spike", start + timedelta(hours=7), 41)]
