from datetime import datetime

import pytest
from pyspark.sql import functions as F

from timberline.plans import lql
from timberline.plans.workspace import Filter, Workspace


@pytest.fixture(scope="module")
def events(spark):
    t = lambda m: datetime(2024, 1, 1, 10, m)
    rows = [
        ("a", 0, t(0), "login ok", "info", 1, "u1"), ("a", 1, t(5), "disk full", "error", 2, "u1"), ("a", 2, t(20), "login ok", None, 1, "u2"), ("a", 3, t(21), "disk full", "warn", 2, None),
        ("b", 0, t(1), "login failed", "warn", 3, "u1"), ("b", 1, t(2), "disk full", "fatal", 2, "u2"), ("b", 2, None, "odd", None, None, "u9"),
    ]
    df = spark.createDataFrame(rows, "stream_id string, source_offset long, time timestamp_ntz, raw string, severity string, template_id long, user string")
    return df.withColumn("attributes", F.when(F.col("user").isNull(), F.array().cast("array<struct<key:string,value:string>>")).otherwise(F.array(F.struct(F.lit("user").alias("key"), F.col("user").alias("value")))))


def found(events, q):
    return sorted((r.stream_id, r.source_offset) for r in lql.run(events, q).collect())


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("severity >= warn", [("a", 1), ("a", 3), ("b", 0), ("b", 1)]),
        ("not severity >= warn", [("a", 0), ("a", 2), ("b", 2)]),
        ("severity = unknown", [("a", 2), ("b", 2)]),
        ("severity != warn", [("a", 0), ("a", 1), ("a", 2), ("b", 1), ("b", 2)]),
        ('text contains "full" and (stream = a or template_id = 2)', [("a", 1), ("a", 3), ("b", 1)]),
        ('text matches "^login (ok|failed)$" or severity = fatal', [("a", 0), ("a", 2), ("b", 0), ("b", 1)]),
        ("attr.user in (u1, u9)", [("a", 0), ("a", 1), ("b", 0), ("b", 2)]),
        ("not attr.user = u1", [("a", 2), ("a", 3), ("b", 1), ("b", 2)]),
        ("severity >= info during [2024-01-01T10:01:00, 2024-01-01T10:05:00]", [("a", 1), ("b", 0), ("b", 1)]),
        ("text contains login then text contains disk within 10m", [("a", 1), ("a", 3), ("b", 1)]),
        ("text contains login then text contains disk within 2m", [("a", 3), ("b", 1)]),
        ("stream = a and (text contains ok then text contains disk within 2m)", [("a", 3)]),
        ("text contains login then text contains full then text contains login", [("a", 2)]),
        ("correlate by attr.user (severity = error, severity = warn) within 5m", [("a", 1), ("b", 0)]),
        ("correlate by attr.user (severity = error, severity = warn) within 3m", []),
    ],
)
def test_queries(events, q, want):
    assert found(events, q) == want


def test_sequence_names_its_nearest_earlier_step(events):
    got = {(r.stream_id, r.source_offset): r.previous_offset for r in lql.run(events, "text contains login then text contains disk").collect()}
    assert got == {("a", 1): 0, ("a", 3): 2, ("b", 1): 0}


@pytest.mark.parametrize("q", ["", "severity", "severity >=", "(text = a", "text contains", "a = b )", "x then", "severity = info within 5m", "text = a during [2024]", "correlate by stream (text = a) within 1h", "text ~ a", "stream = a then stream = b within 5x"])
def test_parse_errors(q):
    with pytest.raises(lql.ParseError):
        lql.parse(q)


@pytest.mark.parametrize("q", ["nosuch = 1", "severity = loud", "severity >= unknown", "text >= a", "template_id contains 3", "template_id = x", 'text matches "("', "text = a during [2024-01-02T00:00:00, 2024-01-01T00:00:00]", "not (text = a then text = b)", "attr. = 3", "(text = a then text = b) or text = c"])
def test_validation_errors(q):
    with pytest.raises(lql.QueryError):
        lql.validate(lql.parse(q))


def test_filters_reach_the_scan(spark, events, tmp_path):
    events.drop("attributes").write.parquet(str(tmp_path / "e"))
    df = lql.run(spark.read.parquet(str(tmp_path / "e")), "stream = a and template_id = 2")
    assert "EqualTo(stream_id,a), EqualTo(template_id,2)" in df._jdf.queryExecution().toString()


def test_viewport_and_fuzzy(spark, events):
    page = [(r.stream_id, r.source_offset) for r in lql.viewport(events, anchor=("a", 2), size=3).collect()]
    assert page == [("a", 2), ("a", 3), ("b", 0)]
    assert [(r.stream_id, r.source_offset) for r in lql.viewport(events, size=2, follow_tail=True).collect()] == [("b", 2), ("b", 1)]
    names = spark.createDataFrame([("nginx access",), ("syslog",), ("nightly axes",)], "n string")
    assert [r.n for r in lql.fuzzy_rank(names, "nga", column="n").collect()] == ["nginx access", "nightly axes"]


def test_workspace(events, tmp_path):
    w = Workspace(streams=["a"], filters=[Filter("severity >= warn"), Filter("template_id = 9", enabled=False)])
    w.submit('text contains "full"')
    assert sorted(r.source_offset for r in w.run(events).collect()) == [1, 3]
    w.anchor, w.size = ("a", 2), 5
    assert [r.source_offset for r in w.page(events).collect()] == [3]
    w.save(str(tmp_path / "w.json"))
    assert Workspace.restore(str(tmp_path / "w.json")) == w
    w.submit("severity = info")
    assert w.recall(0) == 'text contains "full"' and w.history == ['text contains "full"', "severity = info"]


def test_sequence_across_streams(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("a", 1, at(0), "x"), ("b", 1, at(4), "y"), ("b", 2, at(20), "y"), ("c", 1, at(20), "x"), ("c", 2, at(29), "z"), ("a", 2, at(29), "y"), ("a", 3, at(30), "y")]
    df = spark.createDataFrame(rows, "stream_id string, source_offset long, time timestamp_ntz, raw string")
    got = lql.run(df, 'text = "x" then text = "y" within 10m across').collect()
    assert sorted((r.stream_id, r.source_offset, r.previous_time) for r in got) == [("a", 2, at(20)), ("a", 3, at(20)), ("b", 1, at(0))]
    three = lql.run(df, 'text = "x" then text = "z" then text = "y" within 10m across').collect()
    assert sorted((r.stream_id, r.source_offset) for r in three) == [("a", 3)]
    with pytest.raises(lql.ParseError):
        lql.parse('text = "x" then text = "y" across')
