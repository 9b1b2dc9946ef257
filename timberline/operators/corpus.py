"""Evaluation of a miner against labelled lines."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import fnv, masking, scratch
from timberline.operators import mining


class Miner(Protocol):
    """What the corpus asks of a miner: lines (format_id, line, raw) to (format_id, line, pattern, group)."""

    def __call__(self, lines: DataFrame) -> DataFrame: ...


class MissingLabel(ValueError):
    pass


class UnknownTemplate(ValueError):
    pass


def template_miner(lines: DataFrame, params: mining.Params | None = None) -> DataFrame:
    """This engine's miner, with each format's depth; a line that does not parse has no pattern."""
    rows = lines.select(F.col("format_id").alias("stream_id"), F.col("line").alias("source_offset"), masking.masked(masking.tokens(F.col("raw"))).alias("masked"))
    params = params or mining.Params(depths=mining.FORMAT_DEPTH)
    out = mining.mine_online(rows, params)
    return out.select(F.col("stream_id").alias("format_id"), F.col("source_offset").alias("line"), "pattern", F.col("template_id").cast("string").alias("group"))


def check(lines: DataFrame, labels: DataFrame, templates: DataFrame) -> None:
    """Every line has a label, and every label a template."""
    if row := lines.join(labels, ["format_id", "line"], "left_anti").first():
        raise MissingLabel(f"{row['format_id']}, line {row['line']}")
    if row := labels.join(templates, ["format_id", "template_gid"], "left_anti").first():
        raise UnknownTemplate(f"{row['format_id']}, {row['template_gid']}")


def assignments(lines: DataFrame, labels: DataFrame, templates: DataFrame, miner: Miner = template_miner) -> DataFrame:
    """format_id, line, template_gid, expected, mined, group and match of every line."""
    expected = labels.join(templates.withColumnRenamed("pattern", "expected"), ["format_id", "template_gid"])
    both = miner(lines).withColumnRenamed("pattern", "mined").join(expected, ["format_id", "line"])
    return both.select("format_id", "line", "template_gid", "expected", "mined", "group", F.col("mined").eqNullSafe(F.col("expected")).alias("match"))


def accuracy(assigned: DataFrame, by_format: bool = True) -> DataFrame:
    """pa_exact (equal patterns) and pa_grouping (lines whose mined group is the label group); 1 for no lines."""
    # one pass over the lines; all else is counted from the groups
    cells = assigned.groupBy("format_id", "group", "expected").agg(F.count("*").alias("n"), F.count_if("match").alias("equal"))
    cells = scratch.materialize(cells, "cells")
    groups = cells.groupBy("format_id", "group").agg(F.sum("n").alias("n_mined"), F.count("expected").alias("n_expected"))
    labels = cells.groupBy("format_id", "expected").agg(F.sum("n").alias("n_label"))
    rows = cells.join(groups, ["format_id", "group"], "left").join(labels, ["format_id", "expected"], "left")
    same = F.coalesce((F.col("n_expected") == 1) & (F.col("n_mined") == F.col("n_label")), F.lit(False))
    keys = ["format_id"] if by_format else []
    share = lambda of: F.round(F.coalesce(F.sum(of).cast("double") / F.sum("n"), F.lit(1.0)), 6)
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), share("equal").alias("pa_exact"), share(F.when(same, F.col("n")).otherwise(0)).alias("pa_grouping"))


def template_delta(assigned: DataFrame) -> DataFrame:
    """Distinct mined less distinct expected patterns by format; the total is their sum."""
    # pairs are few: they are made distinct before anything is shuffled
    pairs = assigned.groupBy("format_id", "mined", "expected").agg(F.count("*").alias("n"))
    return pairs.groupBy("format_id").agg((F.count_distinct("mined") - F.count_distinct("expected")).alias("delta"))


def set_hash(patterns: DataFrame, column: str = "pattern") -> int:
    """The template set hash of a registry: the distinct patterns in byte order pass by one at a time."""
    rows = patterns.select(F.encode(column, "UTF-8").alias("p")).filter("p is not null").distinct().orderBy("p")
    state = fnv.BASIS
    for row in rows.toLocalIterator(prefetchPartitions=True):
        state = fnv.fnv1a(bytes(row["p"]) + b"\n", state)
    return state


def deterministic(lines: DataFrame, miner: Miner = template_miner) -> bool:
    """Two runs, under other partitions, give the same assignments."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = [miner(lines.repartition(n)).withColumn("__run", F.lit(sign)) for n, sign in ((parts, 1), (parts + 5, -1))]
    both = runs[0].unionByName(runs[1])
    # a row that one run has more often than the other
    return both.groupBy(*(c for c in both.columns if c != "__run")).agg(F.sum("__run").alias("more")).filter("more <> 0").isEmpty()
