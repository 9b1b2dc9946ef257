"""K-d tree sharding: split at weighted medians of the widest metadata dimension.

Each row has a weight (UTF-8 bytes plus 1) and coordinates from 0 to 1 of its
metadata: the logarithm of its size, its source and its language. A node of the tree
is cut along the dimension in which its rows spread widest, at the place that
halves its bytes (or parts them as its leaves need), until there are as many
leaves as the target size asks for. Cuts are found by counting bytes in 4096 bins
of a 62-bit key (22 bits of the coordinate, then 40 bits of a row hash), then in
the bin that holds the median, all nodes of a level at once, by running sums on the executors; the driver sees one
row a node.

Equal texts share coordinates and hash and so stay in one shard. A group of more than ``whole_share`` of a leaf
would push a cut far from the median, so such groups (fewer than leaves / whole_share) are dealt first, by the driver, in
the order of the same dimension, and the cut of the other rows makes up for their weight. Only groups that are heavier
than a whole leaf are cut between rows.

Defined results: a null text weighs 1; null metadata have coordinate 0; repeated
rows are rows of their own; an empty table gives no rows; the columns of the input
other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.cluster import BROADCAST_BYTES, broadcast_if, materialize

_CELL, _HASH, _BIN = 22, 40, 12
_TOP = _CELL + _HASH


def _spread(c: Column) -> Column:
    """A fixed place from 0 to 1 for each value of a category."""
    return F.when(c.isNull(), F.lit(0.0)).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << 40)) / float(1 << 40))


def shards(docs: DataFrame, *, leaves: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", categories: tuple[str, ...] = ("source", "lang"), whole_share: float = 0.05, slack: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; give ``leaves`` or ``target_bytes``."""
    spark = docs.sparkSession
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(text).alias("group"), *(_spread(F.col(c)).alias(f"c{i + 1}") for i, c in enumerate(categories))), "shard")
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = leaves or max(1, -(-total // target_bytes))
    dims = len(categories) + 1
    # one place for all copies of a text; groups heavier than a leaf fall apart into rows
    same = ["group", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.sum("size").alias("weight"), F.count("*").alias("copies"), *(F.min(f"c{i}").alias(f"c{i}") for i in range(1, dims)))
    groups = materialize(groups.filter("copies > 1").withColumn("gid", F.monotonically_increasing_id()), "shard-groups")
    placed = rows.join(broadcast_if(groups.select(*same, "weight", "gid", *(F.col(f"c{i}").alias(f"g{i}") for i in range(1, dims))), BROADCAST_BYTES), same, "left")
    whole = F.coalesce(F.col("weight") <= total / leaves, F.lit(True))
    mark = F.pmod(F.when(whole, F.xxhash64("group", "size")).otherwise(F.xxhash64("group", "doc_id")), F.lit(1 << _HASH))
    at = [F.log2(F.col("size").cast("double")) / 63.0, *(F.when(whole, F.coalesce(f"g{i}", f"c{i}")).otherwise(F.col(f"c{i}")) for i in range(1, dims))]
    cell = lambda c: F.least(F.floor(c * (1 << _CELL)), F.lit((1 << _CELL) - 1)).cast("long")
    heavy = F.coalesce(whole & (F.col("weight") > whole_share * total / leaves), F.lit(False))
    keys = materialize(placed.select("doc_id", "size", "text_crc32", F.when(heavy, F.col("gid")).alias("gid"), "weight", *((F.shiftleft(cell(c), _HASH) + mark).alias(f"k{i}") for i, c in enumerate(at))), "shard-keys")
    span = keys.agg(*(f(F.shiftright(f"k{i}", _HASH)) for i in range(dims) for f in (F.min, F.max))).first()
    span = [max(1, (span[2 * i + 1] or 0) - (span[2 * i] or 0)) for i in range(dims)]
    held = {r["gid"]: (r["weight"], [r[f"k{i}"] for i in range(dims)]) for r in keys.filter("gid is not null").select("gid", "weight", *(f"k{i}" for i in range(dims))).distinct().collect()}

    nodes, inside = {0: (0, leaves)}, {0: sorted(held)}  # node: first shard, number of shards; its heavy groups
    tree = keys.filter("gid is null").drop("gid", "weight").withColumn("node", F.lit(0))
    while any(n > 1 for _, n in nodes.values()):
        open_nodes = {k: n for k, (_, n) in nodes.items() if n > 1}
        now = tree.filter(F.col("node").isin(*open_nodes)) if len(open_nodes) < 50 else tree
        seen = {r["node"]: r for r in now.groupBy("node").agg(F.sum("size").alias("size"), *(f(F.shiftright(f"k{i}", _HASH)).alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.min, F.max))).collect() if r["node"] in open_nodes}
        if not seen and not any(inside.get(k) for k in open_nodes):
            break
        widest, goal, lower = {}, {}, {}
        for k, n in open_nodes.items():
            light, mine = seen[k]["size"] if k in seen else 0, inside.get(k, [])

            def width(i: int, k: int = k, mine: list = mine) -> float:
                ends = [held[g][1][i] >> _HASH for g in mine] + ([seen[k][f"min{i}"], seen[k][f"max{i}"]] if k in seen else [])
                return (max(ends) - min(ends)) / span[i] if ends else 0.0

            widest[k] = max(range(dims), key=lambda i: (width(i), -i))
            want = (light + sum(held[g][0] for g in mine)) * (n // 2) / n
            # heavy groups go to the lower side, in order, up to their share of its bytes
            share, run, lower[k] = sum(held[g][0] for g in mine) * (n // 2) / n, 0, []
            for g in sorted(mine, key=lambda g: (held[g][1][widest[k]], g)):
                if run + held[g][0] / 2 <= share:
                    run += held[g][0]
                    lower[k].append(g)
            goal[k] = min(max(want - run, 0), light)
        cuts = _cuts(now, {k: (widest[k], goal[k]) for k in seen}, slack * total / leaves)
        step, after, inner, fresh = [], {}, {}, 2 * max(nodes) + 2
        for k, (first, n) in nodes.items():
            if n > 1:
                after[fresh], after[fresh + 1] = (first, n // 2), (first + n // 2, n - n // 2)
                inner[fresh], inner[fresh + 1] = lower[k], [g for g in inside.get(k, []) if g not in set(lower[k])]
                if k in cuts:
                    step.append((k, widest[k], cuts[k], fresh))
                fresh += 2
            else:
                after[k], inner[k] = (first, 1), inside.get(k, [])
        if step:
            moves = broadcast_if(spark.createDataFrame(step, "node int, dim int, cut bigint, fresh int"), BROADCAST_BYTES)
            key = F.element_at(F.array(*(f"k{i}" for i in range(dims))), F.col("dim") + 1)
            tree = materialize(tree.join(moves, "node", "left").withColumn("node", F.when(F.col("fresh").isNull(), F.col("node")).otherwise(F.col("fresh") + (key >= F.col("cut")).cast("int"))).drop("dim", "cut", "fresh"), "shard-tree")
        nodes, inside = after, inner
    names = broadcast_if(spark.createDataFrame([(k, first) for k, (first, _) in nodes.items()], "node int, shard int"), BROADCAST_BYTES)
    out = tree.join(names, "node").select("doc_id", "size", "text_crc32", "shard")
    if held:
        dealt = broadcast_if(spark.createDataFrame([(g, nodes[k][0]) for k, mine in inside.items() for g in mine], "gid bigint, shard int"), BROADCAST_BYTES)
        out = out.union(keys.filter("gid is not null").join(dealt, "gid").select("doc_id", "size", "text_crc32", "shard"))
    return _slots(out)


def _cuts(tree: DataFrame, wanted: dict[int, tuple[int, float]], slack: float) -> dict[int, int]:
    """For each node (its dimension and the bytes to lie below) the key from which its upper part begins."""
    spark = tree.sparkSession
    low, below, shift, cuts = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0), _TOP - _BIN, {}
    while len(cuts) < len(wanted):
        todo = [(k, wanted[k][0], low[k], float(wanted[k][1] - below[k])) for k in wanted if k not in cuts]
        look = broadcast_if(spark.createDataFrame(todo, "node int, dim int, low bigint, goal double"), BROADCAST_BYTES)
        key = F.element_at(F.array(*(c for c in tree.columns if c[0] == "k")), F.col("dim") + 1)
        bins = tree.join(look, "node").withColumn("bin", F.shiftright(key - F.col("low"), shift)).filter(F.col("bin").between(0, (1 << _BIN) - 1)).groupBy("node", "goal", "bin").agg(F.sum("size").alias("size"))
        run = bins.withColumn("run", F.sum("size").over(Window.partitionBy("node").orderBy("bin")))
        # the first bin that reaches the goal, or else the last
        reach = F.min(F.when(F.col("run") >= F.col("goal"), F.struct("bin", "size", "run")))
        for r in run.groupBy("node").agg(F.coalesce(reach, F.max(F.struct("bin", "size", "run"))).alias("at")).collect():
            k, at = r["node"], r["at"]
            before, goal = below[k] + at["run"] - at["size"], wanted[k][1]
            begin, end = low[k] + (at["bin"] << shift), low[k] + ((at["bin"] + 1) << shift)
            # nearer end of the bin that holds the median
            if shift == 0 or min(goal - before, before + at["size"] - goal) <= slack:
                cuts[k] = begin if goal - before <= before + at["size"] - goal else end
            low[k], below[k] = begin, before
        shift = max(0, shift - _BIN)
    return cuts


def _slots(rows: DataFrame) -> DataFrame:
    """Numbers each shard's rows from 0: offsets of written partitions, then places within them."""
    rows = materialize(rows.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "shard-slots")
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    begin = sizes.withColumn("begin", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place")) - 1
    return rows.withColumn("local", local).join(begin, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("local")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, *, doc_id: str = "doc_id") -> None:
    """Write ``docs`` as Parquet, one folder a shard; doc_ids must be unique."""
    docs.join(placed.select(F.col("doc_id").alias(doc_id), "shard"), doc_id).write.partitionBy("shard").parquet(path)
