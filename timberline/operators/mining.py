"""Template mining: routing by length and prefix, similarity, widening, ids, registry, re-mining.

A bucket is (stream, number of tokens, first ``depth`` tokens); its templates depend on no other bucket, but for
the numbering, which follows the order in which templates were created in the stream.

A line that came before can widen no template: the one that took it covers it for ever. So templates and their
versions follow from each distinct line's first offset alone:

1. Events are written once, with hashes of their bucket and of their line (124 bits each). Grouping by hash gives the distinct lines with
   their first offsets (combined before the shuffle, so a line that comes a billion times is one row), and tells which buckets hold
   more than one. The line of a bucket that holds no other is its template; its text is never moved for that.
2. For the other buckets a sequential function over the sorted distinct lines keeps the templates and tells which one
   takes each line, and every version of each template with the offset it begins at.
3. An older template can widen until it covers a line that a younger one took; later events of that line are
   then the older one's, as ties go to it. Only buckets where that can be are looked at once more.
4. Events are joined by hash to their line, and to their template's versions by the greatest beginning up to their offset: rows of
   numbers. Only the last join, by the event's own number, moves the text.

What Python sees are distinct lines; what it keeps are templates.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions import scratch

WILD = "<*>"
_BREAK = "\x1e"

#: The numbers of tokens to route by, where a format needs another depth.
FORMAT_DEPTH = {"nginx-access": 5}


class Params:
    """Mining parameters. ``depths`` gives streams another depth; ``most_templates`` is a stream's bound of live templates."""

    def __init__(self, depth: int = 4, threshold: float = 0.5, most_templates: int = 10_000, stable_at: int = 5, depths: dict[str, int] | None = None):
        self.depth, self.threshold, self.most_templates, self.stable_at, self.depths = depth, threshold, most_templates, stable_at, depths or {}

    @classmethod
    def of_formats(cls, formats: dict[str, str], **others) -> Params:
        """Parameters for streams of known formats."""
        return cls(depths={stream: FORMAT_DEPTH[f] for stream, f in formats.items() if f in FORMAT_DEPTH}, **others)

    def depth_of(self, stream: Column) -> Column:
        out = F.lit(self.depth)
        for name, depth in self.depths.items():
            out = F.when(stream == name, depth).otherwise(out)
        return out


def routing_key(masked: Column, depth: int = 4) -> Column:
    """Number of tokens and prefix, the values that the bucket stands for."""
    return F.struct(F.size(masked).alias("n"), F.slice(masked, 1, depth).alias("prefix"))


def similarity(masked: Column, template: Column) -> Column:
    """Share of positions that are equal or wild; 0 for other lengths, 1 for two empty lists."""
    same = F.size(F.filter(F.zip_with(masked, template, lambda a, b: (a == b) | (b == WILD)), lambda x: x))
    return F.when(F.size(masked) != F.size(template), 0.0).when(F.size(masked) == 0, 1.0).otherwise(same / F.size(template))


class Bucket:
    """Templates of one bucket, as the sequential miner sees them."""

    def __init__(self, depth: int, threshold: float):
        self.depth, self.threshold = depth, threshold
        self.templates: list[list] = []  # tokens, created, version, count

    def take(self, tokens: list[str], offset: int) -> tuple[list, bool]:
        """The template that takes the line, and whether it widened; ties go to the older one."""
        n, best, most = len(tokens), None, -1
        need = self.threshold * n - 1e-12
        for t in self.templates:
            if t[0] == tokens:
                same = n
            else:
                same = sum(map(_alike, t[0], tokens))
            if (n == 0 or same >= need) and same > most:
                best, most = t, same
                if same == n:
                    break
        if best is None:
            best = [list(tokens), offset, 1, 0]
            self.templates.append(best)
        best[3] += 1
        wider = most < n and best[3] > 1 and [a if a == b or j < self.depth else WILD for j, (a, b) in enumerate(zip(best[0], tokens, strict=True))]
        if not wider or wider == best[0]:
            return best, False
        best[0], best[2] = wider, best[2] + 1
        return best, True

    def add(self, tokens: list[str], offset: int) -> list:
        return self.take(tokens, offset)[0]


def _alike(mine: str, token: str) -> bool:
    return mine == token or mine == WILD


def _key(params: Params) -> Column:
    """The bucket as a string, each part with its length."""
    prefix = F.transform(F.slice("masked", F.lit(1), F.least(params.depth_of(F.col("stream_id")), F.size("masked"))), lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t))
    return F.concat_ws(_BREAK, F.length("stream_id").cast("string"), "stream_id", F.size("masked").cast("string"), F.array_join(prefix, _BREAK))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches, as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _fold(threshold: float, schema: pa.Schema):
    """Step 2 over rows (bucket, stream_id, depth, masked, first, f1, f2) in order: a row for each line, then one for each version of a template."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema.names]
        now, bucket = None, None

        def put(*row) -> None:
            for to, x in zip(out, row, strict=True):
                to.append(x)

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            for c in out:
                c.clear()
            return got

        for name, stream, depth, tokens, first, f1, f2 in _by_bucket(batches):
            if name != now:
                now, bucket = name, Bucket(depth, threshold)
            before = len(bucket.templates)
            t, widened = bucket.take(tokens, first)
            if widened or len(bucket.templates) > before:
                # an older template that widens below a younger one can come to cover the younger one's lines
                put(True, name, stream, None, t[1], first, t[2], list(t[0]), widened and t is not bucket.templates[-1], None, None)
            put(False, name, stream, tokens, t[1], first, None, None, None, f1, f2)
            if len(out[0]) >= 4096:
                yield batch()
        if out[0]:
            yield batch()

    return fold


def _switches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 over rows (bucket, template or line, created, since, tokens, f1, f2): versions of the bucket's templates first, then its lines.
    Gives lines that an older template takes over, with the offsets from which it does."""
    schema = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("later", pa.list_(pa.struct([("since", pa.int64()), ("created", pa.int64())])))])
    now, versions, out = None, {}, ([], [], [])
    for name, is_version, created, since, tokens, f1, f2 in _by_bucket(batches):
        if name != now:
            now, versions = name, {}
        if is_version:
            versions.setdefault(created, []).append((since, tokens))
            continue
        later = []
        # the youngest of the older ones first: each takes over from those after it
        mine, taken = created, None
        found = []
        for other in sorted(c for c in versions if c < mine):
            begin = next((at for at, t in versions[other] if at > since and all(a == b or a == WILD for a, b in zip(t, tokens, strict=True))), None)
            if begin is not None:
                found.append((begin, other))
        # from an offset on the oldest that covers the line has it
        for begin, other in sorted(found):
            if taken is None or other < taken:
                later.append({"since": begin, "created": other})
                taken = other
        if later:
            for to, x in zip(out, (f1, f2, later), strict=True):
                to.append(x)
            if len(out[0]) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                out = ([], [], [])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def _hashes(text: Column, *parts: Column) -> tuple[Column, Column]:
    """Two numbers that name the parts: their chained hash, and 60 bits of the MD5 of the text they make."""
    chain = F.xxhash64(*parts)
    return chain, F.conv(F.substring(F.md5(F.concat_ws(_BREAK, chain.cast("string"), text)), 1, 15), 16, 10).cast("bigint")


def _held(events: DataFrame, params: Params, order: str) -> DataFrame:
    """Step 1: the events, written, with a number of their own (__id), offset (__at), bucket (__b1, __b2) and line (__f1, __f2);
    the hashes of what does not parse are null."""
    masked, stream = F.col("masked"), F.col("stream_id")
    parsed = F.size(F.coalesce(masked, F.array().cast("array<string>"))) > 0
    prefix = F.slice(masked, F.lit(1), F.least(params.depth_of(stream), F.size(masked)))
    bucket = _hashes(F.concat_ws(_BREAK, stream, F.size(masked).cast("string"), prefix), stream, F.size(masked), prefix)
    line = _hashes(F.concat_ws(_BREAK, stream, masked), stream, masked)
    named = zip(("__b1", "__b2", "__f1", "__f2"), (*bucket, *line), strict=True)
    rows = events.withColumns({"__at": F.col(order).cast("bigint"), **{n: F.when(parsed, c) for n, c in named}})
    return scratch.materialize(rows.withColumn("__id", F.monotonically_increasing_id()), "lines", compression="zstd")


def _mine(held: DataFrame, params: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From written events: the lines (f1, f2, stream_id, the template that takes them as ``created``, the offset that made it, and ``later``
    changes), the templates (stream_id, created, template_id, versions, null for one line's), and the patterns of versions."""
    spark = held.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["stream_id", "__b1", "__b2", "__f1", "__f2"]
    lines = held.filter("__f1 is not null").groupBy(*keys).agg(F.min("__at").alias("first"), F.min_by("__id", "__at").alias("__first"))
    bucket = Window.partitionBy("__b1", "__b2")
    # a bucket of one line has no other line before or after it
    lines = scratch.materialize(lines.withColumn("mixed", F.count("*").over(bucket) > 1), "distinct")
    alone = lines.filter("not mixed").select(F.col("__f1").alias("f1"), F.col("__f2").alias("f2"), "stream_id", F.col("first").alias("created"))

    kind = "template boolean, bucket string, stream_id string, masked array<string>, created bigint, since bigint, version bigint, tokens array<string>, shared boolean, f1 bigint, f2 bigint"
    types = [pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip([f.split()[0] for f in kind.split(", ")], types, strict=True)))
    mixed = lines.filter("mixed").select("__first", "first")
    rows = chosen(held.select("__id", "__at", "stream_id", "masked", "__f1", "__f2"), mixed.select("__first")).withColumnRenamed("__at", "first")
    rows = rows.select(_key(params).alias("bucket"), "stream_id", params.depth_of(F.col("stream_id")).alias("depth"), "masked", "first", "__f1", "__f2")
    told = scratch.materialize(rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "first").mapInArrow(_fold(params.threshold, schema), kind), "mined")
    versions, taken = told.filter("template"), told.filter("not template")

    made = versions.filter("created = since").select("stream_id", "created").union(alone.select("stream_id", "created"))
    ids = made.withColumn("template_id", (F.row_number().over(Window.partitionBy("stream_id").orderBy("created")) - 1).cast("bigint"))
    history = versions.groupBy("stream_id", "created").agg(F.sort_array(F.collect_list(F.struct("since", "version"))).alias("versions"))
    templates = ids.join(history, ["stream_id", "created"], "left")
    patterns = versions.select("stream_id", "created", "version", F.array_join("tokens", " ").alias("pattern"))

    shared = versions.filter("shared").select("bucket").distinct()
    again = versions.select("bucket", F.lit(True).alias("template"), "created", "since", "tokens", "f1", "f2").union(taken.select("bucket", F.lit(False), "created", "since", "masked", "f1", "f2")).join(shared, "bucket", "left_semi")
    again = again.repartition(parts, "bucket").sortWithinPartitions("bucket", F.desc("template"), "since")
    later = again.mapInArrow(_switches, "f1 bigint, f2 bigint, later array<struct<since:bigint,created:bigint>>")
    none = F.lit(None).cast("array<struct<since:bigint,created:bigint>>")
    lines = taken.select("f1", "f2", "stream_id", "created").join(later, ["f1", "f2"], "left").union(alone.withColumn("later", none))
    return lines, templates, patterns


def chosen(held: DataFrame, ids: DataFrame, *, most_bytes: int = 32 << 20) -> DataFrame:
    """The rows whose __id is in ``ids`` (one column, no number twice). A bit for each number is broadcast, as long as that takes
    ``most_bytes`` at most, and no text is moved; beyond it rows are joined by their number."""
    name = ids.columns[0]
    words = ids.groupBy(F.shiftright(name, 6).alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({name} & 63 AS INT))")).alias("__bits"))
    words = scratch.materialize(words, "words")
    if words.count() * 24 > most_bytes:
        return held.join(ids.hint("shuffle_hash"), F.col("__id") == F.col(name), "left_semi")
    rows = held.join(F.broadcast(words), F.shiftright("__id", 6) == F.col("__word"))
    return rows.filter("getbit(__bits, CAST(__id & 63 AS INT)) = 1").drop("__word", "__bits")


#: An event's number without so many bits names its block: consecutive rows, whose text is moved as one compressed value.
BLOCK_BITS = 10


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (__id, ...) to a piece (block, piece) in Parquet's form for each block that a batch has rows of."""
    for batch in batches:
        blocks = batch.column(0).to_numpy() >> BLOCK_BITS
        ends = [*(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else []
        pieces = []
        for start, end in zip([0, *ends], ends, strict=False):
            to = pa.BufferOutputStream()
            rows = pa.Table.from_batches([batch.slice(start, end - start)])
            pq.write_table(rows, to, compression="zstd", use_dictionary=False, write_statistics=False)
            pieces.append(to.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks[[e - 1 for e in ends]], pa.int64()), pa.array(pieces, pa.binary())], ["block", "piece"])


def _unpacked(rows: pa.Table, pieces: pa.Table) -> pa.Table:
    """A block's rows (block, __id, ...) with the masked tokens of their events."""
    if not rows.num_rows:
        return rows.slice(0, 0).drop_columns(["block"]).append_column("masked", pa.array([], pa.list_(pa.string())))
    held = pa.concat_tables([pq.read_table(pa.BufferReader(p.as_buffer()), use_threads=False) for p in pieces["piece"]]).combine_chunks()
    at = pc.index_in(rows["__id"], value_set=held["__id"])
    return rows.drop_columns(["block"]).append_column("masked", held["masked"].take(at))


class Mined:
    """Mined events: numbers by event, and the text they are numbers of, written once. What comes out moves the text once at most."""

    def __init__(self, events: DataFrame, params: Params | None = None, *, order: str = "source_offset"):
        self.params, self.keep, self.order = params or Params(), events.columns, order
        self.held = _held(events, self.params, order)
        lines, templates, self.patterns = _mine(self.held, self.params)
        at = F.col("__at")
        changed = F.filter("later", lambda x: x["since"] <= at)
        # lines that do not parse have no distinct line, and no template
        rows = self.held.filter("__f1 is not null").select("__id", "__at", F.col("__f1").alias("f1"), F.col("__f2").alias("f2")).join(lines, ["f1", "f2"])
        rows = rows.withColumn("created", F.when(F.size(F.coalesce(changed, F.array())) > 0, F.element_at(changed, -1)["created"]).otherwise(F.col("created")))
        now = F.element_at(F.filter("versions", lambda x: x["since"] <= at), -1)["version"]
        rows = rows.select("__id", "__at", "stream_id", "created").join(templates, ["stream_id", "created"])
        # a template of one line has one version, the line
        rows = rows.select("__id", "__at", "stream_id", "created", "template_id", F.coalesce(now, F.lit(1)).cast("int").alias("version"))
        #: __id, __at, stream_id, created, template_id and version of every event that parses
        self.rows = scratch.materialize(rows, "events")

    def with_text(self, rows: DataFrame, *columns, how: str = "inner") -> DataFrame:
        """Rows with an __id of their own, and ``columns`` of the events. Rows are numbers, so they are what is held in memory."""
        held = self.held.select(*columns, F.col("__id").alias("__of"))
        return held.join(rows.hint("shuffle_hash"), F.col("__of") == F.col("__id"), how).drop("__of")

    def with_masked(self, rows: DataFrame) -> DataFrame:
        """Rows with an __id of an event that parses, and its masked tokens. What is shuffled of the text are compressed blocks."""
        text = self.held.filter("__f1 is not null").select("__id", "masked").mapInArrow(_packed, "block bigint, piece binary")
        kind = T.StructType([*rows.schema, T.StructField("masked", T.ArrayType(T.StringType()))])
        return rows.select(F.shiftright("__id", BLOCK_BITS).alias("block"), "*").groupBy("block").cogroup(text.groupBy("block")).applyInArrow(_unpacked, kind)

    def with_pattern(self, rows: DataFrame) -> DataFrame:
        """Adds __pattern, the text of the version if the template ever had another line than its first; else null: it is the event's own."""
        return rows.join(self.patterns.withColumnRenamed("pattern", "__pattern"), ["stream_id", "created", "version"], "left")

    def events(self) -> DataFrame:
        """What ``mine_online`` returns."""
        seen = F.row_number().over(Window.partitionBy("stream_id", "created").orderBy("__at")).cast("bigint")
        rows = self.with_pattern(self.rows.withColumn("seen", seen)).select("__id", "template_id", "version", "seen", "__pattern")
        both = self.with_text(rows, *self.keep, F.array_join("masked", " ").alias("__own"), how="left")
        pattern = F.when(F.col("template_id").isNotNull(), F.coalesce("__pattern", "__own"))
        return both.select(*self.keep, "template_id", pattern.alias("pattern"), "version", "seen")

    def counted(self) -> DataFrame:
        """The registry without its patterns, from numbers alone; with created, and with __id, the last event's."""
        rows = self.rows.groupBy("stream_id", "created", "template_id").agg(F.max_by("version", "__at").alias("version"), F.max_by("__id", "__at").alias("__id"), F.count("*").alias("occurrence_count"), F.min("__at").alias("first_seen"), F.max("__at").alias("last_seen"))
        return rows.withColumn("state", _state(self.params))

    def registry(self) -> DataFrame:
        """What ``registry`` returns for the events."""
        both = self.with_text(self.with_pattern(self.counted()), F.array_join("masked", " ").alias("__own"))
        return both.select("stream_id", "template_id", F.coalesce("__pattern", "__own").alias("pattern"), "version", "occurrence_count", "first_seen", "last_seen", "state")

    def numbers(self) -> DataFrame:
        """stream_id, template_id, version and the order column of the events, without text."""
        return self.rows.select("stream_id", F.col("__at").alias(self.order), "template_id", "version")

    def final(self) -> DataFrame:
        """stream_id, created and __final, the last pattern of templates that had more than one line."""
        return self.patterns.groupBy("stream_id", "created").agg(F.max("version").alias("version")).join(self.patterns, ["stream_id", "created", "version"]).select("stream_id", "created", F.col("pattern").alias("__final"))

    def similarities(self) -> DataFrame:
        """stream_id, the order column and the similarity of every event's line with its template as it is at the end."""
        final, own = self.final(), similarity(F.col("masked"), F.split(F.array_join("masked", " "), " "))
        rows = self.rows.select("__id", "stream_id", "created").join(final, ["stream_id", "created"], "left").select("__id", "__final")
        # a template of one line is its text; other lines' templates come to them
        alone = self.with_text(rows.filter("__final is null").select("__id"), "stream_id", self.order, own.alias("similarity"))
        rows = rows.filter("__final is not null")
        some = chosen(self.held.select(F.col("stream_id"), F.col(self.order), "masked", "__id"), rows.select("__id")).withColumnRenamed("__id", "__of")
        some = some.join(rows, F.col("__of") == F.col("__id")).select("stream_id", self.order, similarity(F.col("masked"), F.split("__final", " ")).alias("similarity"))
        return alone.select("stream_id", self.order, "similarity").union(some)

    def resolve_fingerprints(self, fingerprint: Column) -> DataFrame:
        """What ``resolve_fingerprints`` returns, for a text made of each event's masked tokens."""
        a, b = _hashes(fingerprint, fingerprint)
        keys = self.held.filter("__f1 is not null").select(F.col("__id").alias("__k"), a.alias("a"), b.alias("b"))
        rows = self.rows.join(keys, F.col("__id") == F.col("__k")).groupBy("stream_id", "a", "b")
        rows = rows.agg(F.max_by("template_id", "__at").alias("template_id"), F.max_by("created", "__at").alias("created"), F.max_by("__id", "__at").alias("__id"), F.count("*").alias("events"))
        both = self.with_masked(rows.join(self.final(), ["stream_id", "created"], "left").select("__id", "stream_id", "template_id", "events", "__final"))
        return both.select("stream_id", "template_id", fingerprint.alias("fingerprint"), "events", F.coalesce("__final", F.array_join("masked", " ")).alias("pattern"))

    def split_candidates(self, **bounds) -> DataFrame:
        """What ``split_candidates`` returns: only templates with a wild position and events enough are looked at."""
        least = bounds.get("least_events", 10)
        counts = self.rows.groupBy("stream_id", "created", "template_id").agg(F.count("*").alias("occurrence_count"), F.max("version").alias("version")).filter(F.col("occurrence_count") >= least)
        wild = scratch.materialize(counts.join(self.final(), ["stream_id", "created"]).withColumnRenamed("__final", "pattern"), "wild")
        rows = self.rows.drop("version").join(wild.select("stream_id", "created"), ["stream_id", "created"], "left_semi")
        some = chosen(self.held.select("__id", "masked"), rows.select("__id")).withColumnRenamed("__id", "__of")
        events = some.join(rows, F.col("__of") == F.col("__id")).select("stream_id", "template_id", "masked")
        return split_candidates(events, wild.drop("created"), **bounds)


def mine_online(events: DataFrame, params: Params | None = None, *, order: str = "source_offset") -> DataFrame:
    """stream_id, order, masked and what else comes in, with template_id, pattern (as of the event), version and seen (the
    template's events so far); one offset is one event of its stream. Unparsed lines (null or empty masked) have null results."""
    return Mined(events, params, order=order).events()


def _state(params: Params) -> Column:
    return F.when((F.col("occurrence_count") >= params.stable_at) & (F.col("occurrence_count") > 1), "stable").otherwise("emerging")


def registry(mined: DataFrame, params: Params | None = None, *, order: str = "source_offset") -> DataFrame:
    """Final templates: pattern, version, occurrence_count, first_seen, last_seen, state; a template made by its only event stays emerging even if one suffices."""
    params = params or Params()
    rows = mined.filter("template_id is not null")
    # numbers alone are grouped; the pattern is fetched from the last event
    out = rows.groupBy("stream_id", "template_id").agg(F.max_by("version", order).alias("version"), F.count("*").alias("occurrence_count"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen"))
    last = rows.select("stream_id", "template_id", F.col(order).alias("last_seen"), "pattern").join(out.hint("shuffle_hash"), ["stream_id", "template_id", "last_seen"])
    return last.select("stream_id", "template_id", "pattern", "version", "occurrence_count", "first_seen", "last_seen", _state(params).alias("state"))


def lifecycle(templates: DataFrame, mined: DataFrame, *, now: int, retention: int, recent: int, order: str = "source_offset") -> DataFrame:
    """States with retired (last seen before now - retention) and evolving (widened within the last ``recent`` offsets of the stream)."""
    widened = mined.filter("version > 1").groupBy("stream_id", "template_id", "version").agg(F.min(order).alias("at")).groupBy("stream_id", "template_id").agg(F.max("at").alias("widened_at"))
    state = F.when(F.col("last_seen") < now - retention, "retired").when((F.col("state") == "stable") & (F.col("widened_at") > now - recent), "evolving").otherwise(F.col("state"))
    return templates.join(widened, ["stream_id", "template_id"], "left").withColumn("state", state).drop("widened_at")


def evict(templates: DataFrame, most: int) -> DataFrame:
    """The templates beyond ``most`` of a stream turn cold: lowest count, then oldest last_seen, then lowest id first."""
    stream = Window.partitionBy("stream_id")
    rank = F.row_number().over(stream.orderBy("occurrence_count", "last_seen", "template_id"))
    return templates.withColumns({"__rank": rank, "__live": F.count("*").over(stream)}).withColumn("state", F.when(F.col("__rank") <= F.col("__live") - most, "cold").otherwise(F.col("state"))).drop("__rank", "__live")


def resolve_fingerprints(mined: DataFrame, templates: DataFrame, *, order: str = "source_offset") -> DataFrame:
    """stream_id and fingerprint with the template that has it last, and that template's final pattern."""
    last = mined.filter("template_id is not null").groupBy("stream_id", "fingerprint").agg(F.max_by("template_id", order).alias("template_id"), F.count("*").alias("events"))
    return last.join(templates.select("stream_id", "template_id", "pattern"), ["stream_id", "template_id"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (stream_id, template_id, occurrence_count, version, pattern, side) to a row for each position of the other half, with a hash of
    the tokens without it: chained hashes from both ends, so a pattern is gone through once."""
    names = ["stream_id", "template_id", "occurrence_count", "version", "position", "key"]
    schema = pa.schema([("stream_id", pa.string()), ("template_id", pa.int64()), ("occurrence_count", pa.int64()), ("version", pa.int32()), ("position", pa.int32()), ("key", pa.binary())])

    def chained(tokens: list[bytes]) -> list[bytes]:
        out = [b""]
        for t in tokens:
            out.append(blake2b(out[-1] + t, digest_size=16).digest())
        return out

    out: list[list] = [[] for _ in names]
    for stream, template, count, version, pattern, side in _by_bucket(batches):
        tokens = [t.encode("utf-8", "surrogatepass") for t in pattern.split(" ")]
        n, before, behind = len(tokens), chained(tokens), chained(tokens[::-1])
        for at in range(n // 2, n) if side == 0 else range(n // 2):
            for to, x in zip(out, (stream, template, count, version, at, blake2b(b"%d,%d,%b,%b" % (n, at, before[at], behind[n - 1 - at]), digest_size=16).digest()), strict=True):
                to.append(x)
        if len(out[0]) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            out = [[] for _ in names]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def halves(templates: DataFrame) -> DataFrame:
    """The templates of which another of the stream, as long, has the same first half (side 0) or second half (side 1)."""
    tokens, n = F.split("pattern", " "), F.size(F.split("pattern", " "))
    half = F.floor(n / 2).cast("int")
    sides = [(F.slice(tokens, F.lit(1), half), 0), (F.slice(tokens, half + 1, n - half), 1)]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), *(c.alias(x) for c, x in zip(_hashes(F.concat_ws(_BREAK, t), t), "ab", strict=True))) for t, i in sides)))
    rows = templates.select("stream_id", "template_id", n.alias("n"), each.alias("x")).select("stream_id", "template_id", "n", "x.side", "x.a", "x.b")
    keys = ["stream_id", "n", "side", "a", "b"]
    met = rows.groupBy(*keys).agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    return rows.join(met, keys).select("stream_id", "template_id", "side")


def merge_candidates(templates: DataFrame) -> DataFrame:
    """Pairs with the next template of those that differ at one position alone: the survivor has more events, then the lower id.

    Two that differ at one position alone have their first or their second halves in common. Templates that share a half with another
    meet on the tokens without one position of the other half, by hash; no others are spread, and of a group all name the same survivor.
    """
    met = scratch.materialize(halves(templates), "halves")
    rows = templates.select("stream_id", "template_id", "occurrence_count", F.col("version").cast("int").alias("version"), "pattern").join(met.hint("shuffle_hash"), ["stream_id", "template_id"])
    rows = rows.mapInArrow(_cut, "stream_id string, template_id bigint, occurrence_count bigint, version int, position int, key binary")
    best = Window.partitionBy("stream_id", "position", "key").orderBy(F.desc("occurrence_count"), "template_id")
    rows = rows.withColumns({"survivor": F.first("template_id").over(best), "survivor_version": F.first("version").over(best)})
    rows = rows.filter("survivor <> template_id")
    one = Window.partitionBy("stream_id", "template_id").orderBy("survivor", "position")
    return rows.withColumn("rn", F.row_number().over(one)).filter("rn = 1").select("stream_id", "template_id", "survivor", "position", (F.col("survivor_version") + 1).alias("version"))


def split_candidates(mined: DataFrame, templates: DataFrame, *, least_share: float = 0.2, most_values: int = 4, least_events: int = 10) -> DataFrame:
    """Wild positions with 2 to ``most_values`` constants that each hold ``least_share`` of the template's events."""
    wild = templates.filter(F.col("occurrence_count") >= least_events).select("stream_id", "template_id", F.col("version").alias("was"), "occurrence_count", F.transform(F.filter(F.transform(F.split("pattern", " "), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"] == WILD), lambda x: x["i"]).alias("places")).filter(F.size("places") > 0)
    values = mined.filter("template_id is not null").select("stream_id", "template_id", "masked").join(wild, ["stream_id", "template_id"])
    values = values.select("stream_id", "template_id", "was", "occurrence_count", F.explode(F.transform("places", lambda i: F.struct(i.alias("position"), F.element_at("masked", i + 1).alias("value")))).alias("x"))
    counts = values.groupBy("stream_id", "template_id", F.col("x.position").alias("position"), F.col("x.value").alias("value"), "was", "occurrence_count").agg(F.count("*").alias("n"))
    large = counts.filter(F.col("n") >= least_share * F.col("occurrence_count"))
    out = large.groupBy("stream_id", "template_id", "position", "was", "occurrence_count").agg(F.count("*").alias("n_values"), F.sum("n").alias("covered"), F.array_join(F.array_sort(F.collect_set("value")), "|").alias("constants"))
    return out.filter((F.col("n_values") >= 2) & (F.col("n_values") <= most_values)).select("stream_id", "template_id", "position", "n_values", "covered", "constants", (F.col("was") + 1).alias("version"))


# ---- the same as DuckDB SQL


def _sql_fold(lines: str, depth: int) -> str:
    """CTEs ``l`` and ``r``: the sequential miner over rows (stream_id, source_offset, masked), a line of each bucket a step."""
    made = "{'toks': masked, 'created': source_offset, 'version': 1, 'seen': 1}"
    return f"""
l AS MATERIALIZED (
    SELECT *, dense_rank() OVER (ORDER BY stream_id, len(masked), masked[1:{depth}]) AS b, row_number() OVER (PARTITION BY stream_id, len(masked), masked[1:{depth}] ORDER BY source_offset) AS k
    FROM (SELECT stream_id, source_offset, masked FROM ({lines}) WHERE len(masked) > 0)),
r AS (
    SELECT b, k, stream_id, source_offset, masked, 1 AS hit, [{made}] AS ts FROM l WHERE k = 1
    UNION ALL
    SELECT b, k, stream_id, source_offset, masked, hit, CASE WHEN hit > len(ts) THEN list_append(ts, {made}) ELSE list_transform(ts, lambda t, i:
        CASE WHEN i <> hit THEN t ELSE {{'toks': wide, 'created': t.created, 'version': t.version + CASE WHEN wide <> t.toks THEN 1 ELSE 0 END, 'seen': t.seen + 1}} END) END
    FROM (SELECT *, CASE WHEN hit <= len(ts) THEN list_transform(ts[hit].toks, lambda x, j: CASE WHEN x = masked[j] OR j <= {depth} THEN x ELSE '<*>' END) END AS wide
        FROM (SELECT *, CASE WHEN 2 * list_max(same) >= len(masked) THEN list_position(same, list_max(same)) ELSE len(ts) + 1 END AS hit
            FROM (SELECT l.*, r.ts, list_transform(r.ts, lambda t: len(list_filter(t.toks, lambda x, j: x = l.masked[j] OR x = '<*>'))) AS same FROM r JOIN l ON l.b = r.b AND l.k = r.k + 1))))"""


def sql_mined(lines: str, depth: int = 4) -> str:
    """WITH clause whose ``numbered`` has stream_id, source_offset, masked, template_id, pattern, version and seen, from every line in turn."""
    return f"""WITH RECURSIVE {_sql_fold(lines, depth)},
numbered AS MATERIALIZED (
    SELECT stream_id, source_offset, masked, CAST(dense_rank() OVER (PARTITION BY stream_id ORDER BY t.created) - 1 AS BIGINT) AS template_id, array_to_string(t.toks, ' ') AS pattern, t.version AS version, CAST(t.seen AS BIGINT) AS seen
    FROM (SELECT stream_id, source_offset, masked, ts[hit] AS t FROM r))"""


def sql_mined_distinct(lines: str, depth: int = 4) -> str:
    """The same for streams of many lines and few patterns: distinct lines in turn, then every line's template as of its offset.
    It holds where no older template widens to a younger one's lines."""
    return f"""WITH RECURSIVE src AS MATERIALIZED (SELECT stream_id, source_offset, masked FROM ({lines})), {_sql_fold("SELECT stream_id, min(source_offset) AS source_offset, masked FROM src GROUP BY ALL", depth)},
states AS MATERIALIZED (SELECT stream_id, masked, source_offset AS since, ts[hit].created AS created, ts[hit].version AS version, array_to_string(ts[hit].toks, ' ') AS pattern FROM r),
numbered AS MATERIALIZED (
    SELECT s.stream_id, s.source_offset, s.masked, i.template_id, arg_max(v.pattern, v.since) AS pattern, arg_max(v.version, v.since) AS version, t.created AS created,
           row_number() OVER (PARTITION BY s.stream_id, t.created ORDER BY s.source_offset) AS seen
    FROM src AS s JOIN states AS t ON s.stream_id = t.stream_id AND s.masked = t.masked JOIN states AS v ON v.stream_id = t.stream_id AND v.created = t.created AND v.since <= s.source_offset
    JOIN (SELECT stream_id, created, row_number() OVER (PARTITION BY stream_id ORDER BY created) - 1 AS template_id FROM (SELECT DISTINCT stream_id, created FROM states)) AS i ON i.stream_id = t.stream_id AND i.created = t.created
    GROUP BY s.stream_id, s.source_offset, s.masked, i.template_id, t.created)"""
