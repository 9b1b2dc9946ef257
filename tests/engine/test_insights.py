from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timberline.operators import insights

S = insights.Settings(window="1 hour")
T0 = datetime(2024, 1, 1)


def counts(spark, series):
    rows = [("s", t, T0 + timedelta(hours=h + shift), c) for t, (shift, values) in series.items() for h, c in enumerate(values)]
    return spark.createDataFrame(rows, "stream_id string, template_id string, win_start timestamp_ntz, cnt long")


def fold(values, a=0.3):
    out, level, spread = [(None, None, 0)], float(values[0]), 0.0
    for n, x in enumerate(values[1:], 1):
        out.append((level, spread, n))
        spread = a * abs(x - level) + (1 - a) * spread
        level = a * x + (1 - a) * level
    return out


def test_dense_counts(spark):
    rows = [("s", "t", T0), ("s", "t", T0 + timedelta(hours=3, minutes=5)), ("s", "u", T0 + timedelta(hours=1)), ("s", "u", None)]
    got = insights.window_counts(spark.createDataFrame(rows, "stream_id string, template_id string, time timestamp_ntz"), S).collect()
    assert sorted((r.template_id, r.win_start.hour, r.cnt) for r in got) == [("t", 0, 1), ("t", 1, 0), ("t", 2, 0), ("t", 3, 1), ("u", 1, 1), ("u", 2, 0), ("u", 3, 0)]


@pytest.mark.parametrize("parts", [1, 4])
def test_baselines(spark, parts):
    series = {"t": (0, [5, 6, 0, 9, 4, 4]), "u": (2, [1, 1, 30])}
    got = {(r.template_id, r.win_start): (r.level, r.spread, r.windows_seen) for r in insights.baselines(counts(spark, series).repartition(parts), S).collect()}
    for t, (shift, values) in series.items():
        for h, want in enumerate(fold(values)):
            assert got[t, T0 + timedelta(hours=h + shift)] == pytest.approx(want)


def test_no_lookahead(spark):
    values = [5, 6, 5, 4, 5, 6, 5, 30, 5, 5, 40]
    full = insights.spikes(insights.baselines(counts(spark, {"t": (0, values)}), S), S)
    cut = insights.spikes(insights.baselines(counts(spark, {"t": (0, values[:9])}), S), S)
    early = F.col("win_start") < T0 + timedelta(hours=9)
    assert full.filter(early).collect() == cut.collect() and full.count() == 3  # the first of them in warm-up


def test_detectors(spark):
    base = insights.baselines(counts(spark, {"t": (0, [5, 6, 5, 4, 5, 6, 5, 30] + [0] * 30 + [5]), "new": (4, [3] + [0] * 34), "low": (0, [20] * 12 + [3] + [20] * 26), "up": (0, [5] * 8 + [20, 40, 80] + [5] * 28)}), S)
    assert {(r.template_id, r.win_start.hour) for r in insights.spikes(base, S).collect()} >= {("t", 7), ("up", 8)}
    assert [(r.template_id, r.win_start.hour) for r in insights.emergence(base, S).collect()] == [("new", 4)]
    rare = {(r.template_id, (r.win_start - T0).total_seconds() / 3600) for r in insights.rare(base, S).collect()}
    assert ("low", 12) in rare and ("t", 38) in rare
    runs = [(r.template_id, (r.win_start - T0).seconds // 3600, (r.win_end - T0).seconds // 3600) for r in insights.regressions(base, S).collect() if r.template_id == "up"]
    assert runs == [("up", 8, 10)]
    assert all(0 <= r.confidence < 1 for r in insights.spikes(base, S).collect())


def test_pipeline_order(spark):
    values = [5, 6, 5, 4, 5, 6, 5, 60, 5, 70, 5, 5, 5, 5, 5, 5, 5, 500]
    base = insights.baselines(counts(spark, {"t": (0, values), "early": (0, [1, 50] + [1] * 16)}), S)
    found = insights.spikes(base, S).union(insights.spikes(base, S))
    got = insights.refine(found, S).orderBy("template_id", "win_start").collect()
    assert {r.template_id for r in got} == {"t"}
    pushed = [r for r in got if r.status == "pushed"]
    assert pushed and all(r.confidence >= S.floor for r in pushed) and all("baseline" in r.description for r in got)
    assert sum(r.bumps for r in got) == 3
    muted = spark.createDataFrame([("spike", "s", "t")], "kind string, stream_id string, template_id string")
    assert insights.refine(found, S, muted=muted).count() == 0


def test_related_and_precision(spark):
    base = insights.baselines(counts(spark, {"t": (0, [5, 6, 5, 4, 5, 6, 5, 60])}), S)
    got = insights.refine(insights.spikes(base, S), S)
    events = spark.createDataFrame([("s", "t", T0 + timedelta(hours=7, minutes=m), m) for m in range(30)] + [("s", "t", T0 + timedelta(hours=8), 99)], "stream_id string, template_id string, time timestamp_ntz, source_offset long")
    assert [x.source_offset for x in insights.related(got, events, most=4).first().related] == [0, 1, 2, 3]
    labels = spark.createDataFrame([("spike", "s", "t", T0 + timedelta(hours=7)), ("spike", "s", "t", T0)], "kind string, stream_id string, template_id string, win_start timestamp_ntz")
    r = insights.precision(insights.spikes(base, S), labels).first()
    assert (r.hits, r.precision, r.recall) == (1, 0.5, 0.5)  # one more in warm-up


def test_clamp(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (7.0,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(insights.clamp(F.col("x"))).collect()] == [0.0, 0.5, 1.0, None]
