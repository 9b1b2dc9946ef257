"""Baselines, detectors and the precision pipeline over counts by window.

Subjects are (stream_id, template_id). All detectors look at the baseline before the
window they judge. Constants are this engine's own defaults.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUBJECT = ["stream_id", "template_id"]


@dataclass(frozen=True)
class Settings:
    window: str = "1 hour"
    alpha: float = 0.3
    k: float = 3.0
    warmup: int = 5
    persist: int = 3
    min_volume: int = 5
    floor: float = 0.5
    cooldown: int = 3
    percentile: float = 0.05
    gap: int = 24


def window_counts(events: DataFrame, s: Settings = Settings(), *, time: str = "time", errors: Column | None = None) -> DataFrame:
    """stream_id, template_id, win_start, cnt (and errors): every window between a subject's first and the stream's last, empty ones too."""
    width = F.window(time, s.window)
    rows = events.filter(F.col(time).isNotNull()).groupBy(*SUBJECT, width.alias("w")).agg(F.count("*").alias("cnt"), F.sum(F.coalesce(errors, F.lit(False)).cast("int") if errors is not None else F.lit(0)).alias("errors"))
    return dense(rows.select(*SUBJECT, F.col("w.start").alias("win_start"), "cnt", "errors"), s)


def dense(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Counts by window (subject, win_start, cnt, errors) with the empty windows."""
    last = rows.groupBy("stream_id").agg(F.max("win_start").alias("last"))
    first = rows.groupBy(*SUBJECT).agg(F.min("win_start").alias("first"))
    every = first.join(last, "stream_id").select(*SUBJECT, F.explode(F.sequence("first", "last", F.expr(f"interval {s.window}"))).alias("win_start"))
    return every.join(rows, [*SUBJECT, "win_start"], "left").select(*SUBJECT, "win_start", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"), F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"))


def baselines(counts: DataFrame, s: Settings = Settings(), *, value: str = "cnt") -> DataFrame:
    """Adds level, spread and windows_seen as they were before each window (null before a subject's first): an ordered fold, whose state goes from batch to batch."""
    a = s.alpha
    schema = T.StructType([*counts.schema, T.StructField("level", T.DoubleType()), T.StructField("spread", T.DoubleType()), T.StructField("windows_seen", T.LongType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, level, spread, seen = None, 0.0, 0.0, 0
        for batch in batches:
            out = []
            for key, x in zip(zip(*(batch[c] for c in SUBJECT), strict=True), batch[value], strict=True):
                x = float(x)
                if key != subject:
                    subject, level, spread, seen = key, x, 0.0, 1
                    out.append((None, None, 0))
                    continue
                out.append((level, spread, seen))
                spread = a * abs(x - level) + (1 - a) * spread
                level = a * x + (1 - a) * level
                seen += 1
            yield batch.assign(level=[r[0] for r in out], spread=[r[1] for r in out], windows_seen=[r[2] for r in out])

    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.repartition(parts, *SUBJECT).sortWithinPartitions(*SUBJECT, "win_start").mapInPandas(fold, schema)


def effect(value: str = "cnt") -> Column:
    return (F.col(value) - F.col("level")) / F.greatest(F.col("spread"), F.lit(1.0))


def confidence(s: Settings, value: str = "cnt") -> Column:
    """From effect size, maturity and volume; 1 is never reached."""
    z = F.greatest(effect(value), F.lit(0.0))
    c = F.least(F.lit(1.0), z / (2 * s.k)) * F.least(F.lit(1.0), F.col("windows_seen") / (2.0 * s.warmup)) * (F.col(value) / (F.col(value) + s.min_volume))
    return F.round(clamp(F.least(F.lit(0.99), c)), 6)


def clamp(c: Column) -> Column:
    """Confidences lie from 0 to 1; what is no number is none."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def _above(s: Settings, value: str = "cnt") -> Column:
    return F.col(value) > F.col("level") + s.k * F.col("spread")


_OUT = ["kind", *SUBJECT, "win_start", "win_end", "cnt", "level", "spread", "windows_seen", "confidence"]


def _as(kind: str, rows: DataFrame, confidence: Column, end: Column | None = None) -> DataFrame:
    return rows.withColumns({"kind": F.lit(kind), "confidence": confidence, "win_end": end if end is not None else F.col("win_start")}).select(*_OUT)


def spikes(base: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Above level + k spread and of at least the least volume."""
    return _as("spike", base.filter(_above(s) & (F.col("cnt") >= s.min_volume)), confidence(s))


def rare(base: DataFrame, s: Settings = Settings(), *, stable_at: int = 5) -> DataFrame:
    """A stable subject past warm-up in the low percentile of its own earlier windows, or back after a gap of empty ones."""
    before = Window.partitionBy(*SUBJECT).orderBy("win_start").rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(Window.partitionBy(*SUBJECT).orderBy("win_start"))
    rows = base.withColumns({"__n": n, "__sum": F.sum("cnt").over(before), "__low": F.percentile_approx("cnt", s.percentile, 10_000).over(before), "__least": F.min("cnt").over(before)})
    rows = rows.withColumn("__at", F.when(F.col("cnt") > 0, F.col("__n"))).withColumn("__last", F.max("__at").over(before))
    known = (F.col("__sum") >= stable_at) & (F.col("windows_seen") >= s.warmup) & (F.col("cnt") > 0)
    low = (F.col("cnt") < F.col("level")) & (F.col("cnt") <= F.col("__low")) & (F.col("__low") > 0)
    back = F.col("__n") - F.col("__last") > s.gap
    below = F.col("level") / F.greatest(F.col("spread"), F.lit(1.0)) / (2 * s.k)
    sure = F.least(F.lit(0.99), F.least(F.lit(1.0), F.when(back, F.lit(1.0)).otherwise(below)) * F.least(F.lit(1.0), F.col("windows_seen") / (2.0 * s.warmup)) * (F.col("__sum") / (F.col("__sum") + s.min_volume)))
    return _as("rare", rows.filter(known & (low | back)), F.round(clamp(sure), 6))


def emergence(base: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A subject's first window, but for the stream's first."""
    opened = base.groupBy("stream_id").agg(F.min("win_start").alias("__opened"))
    first = base.filter("windows_seen = 0 and cnt > 0").join(opened, "stream_id").filter("win_start > __opened")
    return _as("emergence", first, F.round(F.lit(0.5) * F.col("cnt") / (F.col("cnt") + s.min_volume), 6))


def regressions(base: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Error-bearing counts (column cnt) above the baseline in each of ``persist`` windows on end, or a new error-bearing subject in its first ones; one row a run, with its last window as win_end.

    The baseline of a run is that before its first window.
    """
    order = Window.partitionBy(*SUBJECT).orderBy("win_start")
    opened = base.groupBy("stream_id").agg(F.min("win_start").alias("__opened"))
    rows = base.join(opened, "stream_id").withColumn("__n", F.row_number().over(order))
    new = (F.min("win_start").over(Window.partitionBy(*SUBJECT)) > F.col("__opened")) & (F.col("__n") <= s.persist) & (F.col("cnt") > 0)
    rows = rows.withColumn("__new", new).withColumn("__flag", F.coalesce((_above(s) & (F.col("cnt") >= s.min_volume) & (F.col("windows_seen") >= s.warmup)), F.lit(False)) | F.col("__new"))
    rows = rows.filter("__flag").withColumn("__run", F.col("__n") - F.row_number().over(order))
    first = F.min_by(F.struct("level", "spread", "windows_seen"), "win_start")
    runs = rows.groupBy(*SUBJECT, "__run").agg(F.min("win_start").alias("win_start"), F.max("win_start").alias("win_end"), F.count("*").alias("n"), F.max("cnt").alias("cnt"), first.alias("b"), F.max("__new").alias("new")).filter(F.col("n") >= s.persist)
    runs = runs.select(*SUBJECT, "win_start", "win_end", "cnt", F.coalesce("b.level", F.lit(0.0)).alias("level"), F.coalesce("b.spread", F.lit(0.0)).alias("spread"), "b.windows_seen", "n")
    return _as("regression", runs, F.round(confidence(s) * F.least(F.lit(1.0), F.col("n") / float(s.persist)), 6), F.col("win_end"))


def describe() -> Column:
    """What was seen, against what, with how strong an effect."""
    return F.format_string("%s of template %s in %s: %d in the window, baseline %.2f +- %.2f over %d windows", "kind", F.col("template_id").cast("string"), "stream_id", "cnt", F.coalesce("level", F.lit(0.0)), F.coalesce("spread", F.lit(0.0)), "windows_seen")


def refine(candidates: DataFrame, s: Settings = Settings(), *, muted: DataFrame | None = None) -> DataFrame:
    """Warm-up, effect and volume, floor, dedup, cooldown and suppression, in that order: insights with status (pushed or on_demand) and bumps (candidates merged)."""
    ripe = candidates.filter((F.col("kind").isin("emergence", "regression")) | (F.col("windows_seen") >= s.warmup))
    strong = ripe.filter(~F.col("kind").isin("spike") | (_above(s) & (F.col("cnt") >= s.min_volume)))
    rated = strong.withColumn("status", F.when(F.col("confidence") >= s.floor, "pushed").otherwise("on_demand"))
    best = Window.partitionBy("kind", *SUBJECT, "win_start").orderBy(F.desc("confidence"), "win_end")
    single = rated.withColumn("__rn", F.row_number().over(best)).filter("__rn = 1").drop("__rn")
    # pushed ones within the cooldown of the one before extend it
    order = Window.partitionBy("kind", *SUBJECT, "status").orderBy("win_start")
    seconds = F.unix_micros(F.col("win_start").cast("timestamp")) / 1_000_000
    length = F.lit(float(_seconds(s.window) * s.cooldown))
    opens = F.coalesce(seconds - F.lag(seconds).over(order) > length, F.lit(True)) | (F.col("status") == "on_demand")
    grouped = single.withColumn("__o", opens.cast("int")).withColumn("__g", F.sum("__o").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    top = F.max_by(F.struct("cnt", "level", "spread", "windows_seen"), F.struct("confidence", F.col("cnt")))
    merged = grouped.groupBy("kind", *SUBJECT, "status", "__g").agg(F.min("win_start").alias("win_start"), F.max("win_end").alias("win_end"), F.max("confidence").alias("confidence"), F.count("*").alias("bumps"), top.alias("x"))
    out = merged.select("kind", *SUBJECT, "status", "win_start", "win_end", "confidence", "bumps", "x.*")
    if muted is not None:
        # a mute without a stream holds for all
        out = out.join(muted.filter("stream_id is not null"), ["kind", *SUBJECT], "left_anti").join(muted.filter("stream_id is null").select("kind", "template_id"), ["kind", "template_id"], "left_anti")
    return out.withColumn("description", describe())


def _seconds(window: str) -> int:
    n, unit = window.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def related(insights: DataFrame, events: DataFrame, *, time: str = "time", window: str = "1 hour", most: int = 10) -> DataFrame:
    """Adds related: the first anchors (stream_id, source_offset) of an insight's events up to its last window's end."""
    w = insights.withColumn("__id", F.monotonically_increasing_id())
    hits = w.select("__id", *SUBJECT, "win_start", "win_end").join(events.select(*SUBJECT, F.col(time).alias("__t"), "source_offset"), SUBJECT)
    hits = hits.filter((F.col("__t") >= F.col("win_start")) & (F.col("__t") < F.col("win_end") + F.expr(f"interval {window}")))
    rank = F.row_number().over(Window.partitionBy("__id").orderBy("source_offset"))
    few = hits.withColumn("__rn", rank).filter(F.col("__rn") <= most).groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("stream_id", "source_offset"))).alias("related"))
    return w.join(few, "__id", "left").drop("__id")


def precision(insights: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision and recall of each kind against labels (kind, subject, win_start)."""
    keys = ["kind", *SUBJECT, "win_start"]
    both = insights.select(*keys).distinct().withColumn("__i", F.lit(1)).join(labels.select(*keys).distinct().withColumn("__l", F.lit(1)), keys, "full")
    hit = F.sum(F.coalesce(F.col("__i") * F.col("__l"), F.lit(0)))
    return both.groupBy("kind").agg(hit.cast("bigint").alias("hits"), F.round(F.try_divide(hit, F.sum("__i")), 6).alias("precision"), F.round(F.try_divide(hit, F.sum("__l")), 6).alias("recall"))
