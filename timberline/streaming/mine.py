"""Streaming: online mining with bounded keyed state, per-stream watermarks that drop nothing, detection, and idempotent sealing.

Online template ids are the fingerprint of the event that made the template; dense
ids come from the batch miner.
"""

from __future__ import annotations

import heapq
import json
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from timberline.functions import fnv
from timberline.operators import insights
from timberline.operators.mining import Bucket, Params

MINED = "stream_id string, source_offset bigint, template_key bigint, pattern string, version int, seen bigint, fingerprint bigint"
#: Distinct lines of a bucket whose template is remembered within a batch.
MOST_KNOWN = 200_000
#: Offsets of a line that move as one value at most: Spark holds 10,000 such rows at once.
PIECE = 256
#: Events that are mined at once.
FRAME = 16_384
KEYS = ["stream_id", "depth", "n", "prefix"]
PACKED = "stream_id string, depth int, n int, prefix string, line string, fingerprint bigint, offsets binary"
#: A row for the events of a frame that have the same line and version, or for ``PIECE`` of them.
MINED_AT_ONCE = "stream_id string, template_key bigint, pattern string, version int, fingerprint bigint, offsets array<bigint>, seen array<bigint>"
LATE = "stream_id string, source_offset bigint, event_time timestamp, watermark timestamp, lateness string"


class LiveBucket(Bucket):
    """A bucket whose templates are state: bounded, and quick for lines that came before.

    Beyond ``most`` templates the least valuable one turns cold (least count, then oldest, then first made): it takes no more
    lines, and a line like its own makes a template again.
    """

    def __init__(self, depth: int, threshold: float, most: int, held: list[list] | None = None):
        super().__init__(depth, threshold)
        self.templates, self.most, self.known = held or [], most, {}
        #: What the last line made unknown: the lines of one template, or those of all (the bucket itself).
        self.lost: object = None

    def add(self, tokens: tuple[str, ...], offset: int) -> list:
        self.lost = None
        t = self.known.get(tokens)
        if t is not None:
            # what took the line covers it, so nothing widens
            t[3] += 1
            return t
        before = len(self.templates)
        t, widened = self.take(list(tokens), offset)
        if widened and t is not self.templates[-1]:
            # an older template may now cover lines that a younger one took
            self.known.clear()
            self.lost = self
        if len(self.templates) > max(before, self.most):
            cold = min(self.templates[:-1], key=lambda x: (x[3], x[4] if len(x) > 4 else -1))
            self.templates.remove(cold)
            self.known = {k: v for k, v in self.known.items() if v is not cold}
            self.lost = cold
        self.known[tokens] = t
        return t

    def add_all(self, offsets: np.ndarray, codes: np.ndarray, lines: list[tuple[str, ...]], prints: list[int]) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """What ``add`` gives event by event, for offsets in order and the places of their lines in ``lines``, each of which occurs: the place
        of each event's version in the third result (template, key, pattern, version), and its template's events so far.

        Only lines that are not known are compared; events between those are counted at once.
        """
        which, seen = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
        held: list[list | None] = [self.known.get(x) for x in lines]
        spelt: list[tuple] = []
        places: dict[tuple[int, int], int] = {}

        def place(t: list) -> int:
            at = (id(t), t[2])
            if at not in places:
                places[at] = len(spelt)
                spelt.append((t, t[1], " ".join(t[0]), t[2]))
            return places[at]

        def bulk(start: int, end: int) -> None:
            """Events whose lines are all known."""
            if end - start < 32:
                for k in range(start, end):
                    t = held[codes[k]]
                    t[3] += 1
                    t[4:] = [int(offsets[k])]
                    which[k], seen[k] = place(t), t[3]
                return
            used, at = np.unique(codes[start:end], return_inverse=True)
            of = {id(held[c]): held[c] for c in used.tolist()}
            slot = {t: k for k, t in enumerate(of)}
            slots = np.array([slot[id(held[c])] for c in used.tolist()], np.uint16)[at]
            order, counts = np.argsort(slots, kind="stable"), np.bincount(slots)
            ends = np.cumsum(counts)
            rank = np.empty(end - start, np.int64)
            rank[order] = np.arange(1, end - start + 1) - np.repeat(ends - counts, counts)
            seen[start:end] = np.array([t[3] for t in of.values()])[slots] + rank
            which[start:end] = np.array([place(t) for t in of.values()])[slots]
            for t, n, last in zip(of.values(), counts.tolist(), order[ends - 1].tolist(), strict=True):
                t[3] += n
                t[4:] = [int(offsets[start + last])]

        done = 0
        if any(t is None for t in held):
            order = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(lines))).tolist()
            starts = [0, *ends[:-1]]
            # the next event of each line that is not known
            due = [(int(order[starts[c]]), c) for c, t in enumerate(held) if t is None]
            heapq.heapify(due)
            while due:
                k, c = heapq.heappop(due)
                bulk(done, k)
                t = held[c] = self.add(lines[c], prints[c])
                t[4:] = [int(offsets[k])]
                which[k], seen[k] = place(t), t[3]
                done = k + 1
                if self.lost is None:
                    continue
                for other, x in enumerate(held):
                    if x is not None and other != c and (self.lost is self or x is self.lost):
                        held[other] = None
                        at = starts[other] + int(np.searchsorted(order[starts[other] : ends[other]], k, side="right"))
                        if at < ends[other]:
                            heapq.heappush(due, (int(order[at]), other))
        bulk(done, len(codes))
        return which, seen, spelt


def in_order(batches: Iterator[pd.DataFrame], *, order: str = "source_offset", run: int = 100_000, piece: int = 8_192) -> Iterator[pd.DataFrame]:
    """The rows of a key in order, equal ones as they came, in frames of bounded size. More than ``run`` rows go to files
    in sorted runs, of which a piece each is held while they are merged."""
    held, n, runs = [], 0, []
    with tempfile.TemporaryDirectory(prefix="timberline-runs-") as folder:

        def put() -> None:
            path = os.path.join(folder, str(len(runs)))
            table = pa.Table.from_pandas(pd.concat(held).sort_values(order, kind="stable"), preserve_index=False)
            with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                w.write_table(table, max_chunksize=piece)
            runs.append(path)
            held.clear()

        for rows in batches:
            for at in range(0, len(rows), run):
                held.append(rows.iloc[at : at + run])
                n += len(held[-1])
                if n >= run:
                    put()
                    n = 0
        if not runs:
            rows = pd.concat(held).sort_values(order, kind="stable") if held else None
            for at in range(0, n, piece):
                yield rows.iloc[at : at + piece]
            return
        if held:
            put()
        yield from _merged(runs, order)


def _merged(runs: list[str], order: str) -> Iterator[pd.DataFrame]:
    """Rows of sorted runs up to the least of the runs' last rows in hand come next: no row that is still to be read is before them."""
    readers = [pa.ipc.open_stream(pa.OSFile(path, "rb")) for path in runs]
    hand: list[pd.DataFrame | None] = [None] * len(runs)
    left = set(range(len(runs)))
    while True:
        for k in sorted(left):
            while hand[k] is None or not len(hand[k]):
                try:
                    hand[k] = readers[k].read_next_batch().to_pandas()
                except StopIteration:
                    hand[k] = None
                    left.discard(k)
                    break
        have = [k for k in range(len(runs)) if hand[k] is not None and len(hand[k])]
        if not have:
            return
        # a run that goes on may have more rows equal to its last one: those of later runs wait for them
        bound = min((hand[k][order].iloc[-1], k) for k in have)
        out = []
        for k in have:
            at = int(hand[k][order].searchsorted(bound[0], side="right" if k <= bound[1] else "left"))
            out.append(hand[k].iloc[:at])
            hand[k] = hand[k].iloc[at:]
        yield pd.concat(out).sort_values(order, kind="stable")


def packed(batches: Iterator[pa.RecordBatch], *, most: int = 1 << 18, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Events (the keys, line, source_offset) to rows of ``PACKED``: of every ``most`` events or so, a line is one row with its offsets
    as 64-bit numbers, or one for each ``PIECE`` of them."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= most or size >= most_bytes:
            yield _pieces(held)
            held, n, size = [], 0, 0
    if n:
        yield _pieces(held)


def _begins(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes, one behind the other: the run of each piece of at most ``PIECE``, and where the piece begins."""
    pieces = -(-sizes // PIECE)
    of = np.repeat(np.arange(len(sizes)), pieces)
    return of, (np.cumsum(sizes) - sizes)[of] + PIECE * (np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of])


def _pieces(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).group_by([*KEYS, "line"], use_threads=False).aggregate([("source_offset", "list")]).combine_chunks()
    lists = pa.concat_arrays(rows["source_offset_list"].chunks)
    of, begin = _begins(lists.value_lengths().to_numpy())
    flat = np.ascontiguousarray(lists.flatten().to_numpy(), np.int64)
    ends = np.append(begin, len(flat)).astype(np.int32) * 8
    prints = fnv.fnv_batch(rows["line"].to_pylist()).view(np.int64)[of]
    keys = rows.select([*KEYS, "line"]).take(pa.array(of)).combine_chunks().columns
    offsets = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    return pa.RecordBatch.from_arrays([*(c.chunk(0) for c in keys), pa.array(prints), offsets], [*KEYS, "line", "fingerprint", "offsets"])


Turn = tuple[np.ndarray, np.ndarray, list[str], list[int]]


def turns(batches: Iterator[pd.DataFrame], *, run: int = 1 << 20, most_bytes: int = 32 << 20, piece: int = 8_192, frame: int = FRAME) -> Iterator[Turn]:
    """The offsets of a key's rows (line, fingerprint, offsets) in order, equal ones as they came, in frames of bounded size: offsets, the places of
    their lines, lines and fingerprints. More than ``run`` of them, or lines of more than ``most_bytes``, go to files in sorted runs, as ``in_order`` does it for rows."""
    places: dict[str, int] = {}
    prints: list[int] = []
    codes, held, runs = [], [], []
    n = size = 0
    with tempfile.TemporaryDirectory(prefix="timberline-runs-") as folder:

        def in_hand() -> Turn:
            offsets = np.frombuffer(b"".join(held), np.int64)
            each = np.repeat(np.array(codes, np.int32), [len(x) // 8 for x in held])
            order = np.argsort(offsets, kind="stable")
            return offsets[order], each[order], list(places), list(prints)

        def put() -> None:
            nonlocal n, size
            path = os.path.join(folder, str(len(runs)))
            with open(path, "wb") as f:
                for part in _cut(in_hand(), piece):
                    pickle.dump(part, f)
            runs.append(path)
            for x in (places, prints, codes, held):
                x.clear()
            n = size = 0

        for rows in batches:
            for line, mark, offsets in zip(rows.line, rows.fingerprint, rows.offsets, strict=True):
                if line not in places:
                    places[line] = len(places)
                    prints.append(int(mark))
                    size += len(line)
                codes.append(places[line])
                held.append(offsets)
                n += len(offsets) // 8
                if n >= run or size >= most_bytes:
                    put()
        if not runs:
            yield from _cut(in_hand(), frame)
            return
        if held:
            put()
        yield from _in_turn(runs, frame)


def _some(part: Turn, start: int, end: int) -> Turn:
    """Some events of a part, with the lines that they have."""
    offsets, codes, lines, prints = part
    used, at = np.unique(codes[start:end], return_inverse=True)
    return offsets[start:end], at.astype(np.int32), [lines[c] for c in used.tolist()], [prints[c] for c in used.tolist()]


def _cut(part: Turn, size: int) -> Iterator[Turn]:
    for at in range(0, len(part[0]), size):
        yield _some(part, at, at + size)


def _joined(parts: list[Turn]) -> Turn:
    """Parts as one, in order; of equal offsets those of earlier parts come first."""
    places: dict[str, int] = {}
    prints, codes = [], []
    for _offsets, mine, lines, marks in parts:
        to = []
        for line, mark in zip(lines, marks, strict=True):
            if line not in places:
                places[line] = len(places)
                prints.append(mark)
            to.append(places[line])
        codes.append(np.array(to, np.int32)[mine])
    offsets, each = np.concatenate([p[0] for p in parts]), np.concatenate(codes)
    order = np.argsort(offsets, kind="stable")
    return offsets[order], each[order], list(places), prints


def _in_turn(runs: list[str], frame: int) -> Iterator[Turn]:
    """Events of sorted runs up to the least of the runs' last ones in hand come next: none that is still to be read is before them."""
    files = [open(path, "rb") for path in runs]
    try:
        hand: list[Turn | None] = [None] * len(runs)
        starts = [0] * len(runs)
        left, out, n = set(range(len(runs))), [], 0
        while True:
            for k in sorted(left):
                if hand[k] is None or starts[k] == len(hand[k][0]):
                    try:
                        hand[k], starts[k] = pickle.load(files[k]), 0
                    except EOFError:
                        hand[k] = None
                        left.discard(k)
            have = sorted(left)
            if not have:
                break
            # a run that goes on may have more events equal to its last one: those of later runs wait for them
            bound = min((hand[k][0][-1], k) for k in have)
            for k in have:
                end = int(np.searchsorted(hand[k][0], bound[0], side="right" if k <= bound[1] else "left"))
                if end > starts[k]:
                    out.append(_some(hand[k], starts[k], end))
                    n += end - starts[k]
                    starts[k] = end
            if n >= frame:
                yield _joined(out)
                out, n = [], 0
        if out:
            yield _joined(out)
    finally:
        for f in files:
            f.close()


def mine_stream(events: DataFrame, params: Params | None = None) -> DataFrame:
    """A streaming frame of stream_id, source_offset and masked, mined by bucket; the rows of a batch are taken in order of their offsets.
    State holds at most ``most_templates`` templates a bucket.

    A bucket is one task's. What moves to it and from it are lines with packed offsets, and it compares a line once: its time grows with the
    bucket's events only by what sorting and counting numbers take. Lines are packed, and events written, by all tasks.
    """
    p = params or Params()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bucket = LiveBucket(key[1], p.threshold, p.most_templates, json.loads(state.get[0]) if state.exists else None)
        for offsets, codes, lines, prints in turns(batches):
            which, seen, spelt = bucket.add_all(offsets, codes, [tuple(x.split(fnv.SEPARATOR)) for x in lines], prints)
            both = which * len(lines) + codes
            order = np.argsort(both, kind="stable")
            runs = np.flatnonzero(np.diff(both[order])) + 1
            begin = _begins(np.diff(runs, prepend=0, append=len(both)))[1]
            first, cuts = both[order[begin]], begin[1:]
            of = [spelt[k] for k in (first // len(lines)).tolist()]
            out = {"stream_id": [key[0]] * len(of), "template_key": [x[1] for x in of], "pattern": [x[2] for x in of], "version": [x[3] for x in of], "fingerprint": [prints[k] for k in (first % len(lines)).tolist()]}
            yield pd.DataFrame(out | {"offsets": np.split(offsets[order], cuts), "seen": np.split(seen[order], cuts)})
            # what is remembered of lines only saves time
            if len(bucket.known) > MOST_KNOWN:
                bucket.known.clear()
        state.update((json.dumps(bucket.templates),))

    depth = p.depth_of(F.col("stream_id"))
    rows = events.filter(F.size("masked") > 0).withColumns({"depth": depth, "n": F.size("masked"), "prefix": F.array_join(F.slice("masked", F.lit(1), F.least(depth, F.size("masked"))), fnv.SEPARATOR)})
    rows = rows.select(*KEYS, F.array_join("masked", fnv.SEPARATOR).alias("line"), F.col("source_offset").cast("bigint").alias("source_offset")).mapInArrow(packed, PACKED)
    mined = rows.groupBy(*KEYS).applyInPandasWithState(step, MINED_AT_ONCE, "templates string", "append", GroupStateTimeout.NoTimeout)
    # the first offset is computed before the shuffle: the rows of Arrow batches cannot be shuffled as they are
    spread = mined.withColumn("first", F.element_at("offsets", 1)).repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "first")
    each = spread.select("stream_id", F.explode(F.arrays_zip("offsets", "seen")).alias("e"), "template_key", "pattern", "version", "fingerprint")
    return each.select("stream_id", F.col("e.offsets").alias("source_offset"), "template_key", "pattern", "version", F.col("e.seen").alias("seen"), "fingerprint")


def lateness_stream(events: DataFrame, *, bound_seconds: int = 600) -> DataFrame:
    """Late events flagged against their own stream's greatest earlier time; all rows stay."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mark = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values("source_offset")
        for stream, offset, at in zip(rows.stream_id, rows.source_offset, rows.event_time, strict=True):
            if pd.isna(at):
                out.append((stream, offset, None, mark, None))
                continue
            gap = 0 if mark is None else (mark - at).total_seconds()
            out.append((stream, offset, at, mark, "on_time" if gap <= 0 else "late" if gap <= bound_seconds else "very_late"))
            mark = at if mark is None else max(mark, at)
        if mark is not None:
            state.update((mark.to_pydatetime(),))
        yield pd.DataFrame(out, columns=["stream_id", "source_offset", "event_time", "watermark", "lateness"]).astype({"event_time": "datetime64[ns]", "watermark": "datetime64[ns]"})

    return events.groupBy("stream_id").applyInPandasWithState(step, LATE, "mark timestamp", "append", GroupStateTimeout.NoTimeout)


def window_counts_stream(events: DataFrame, window: str = "1 hour", *, time: str = "time", late: str | None = None) -> DataFrame:
    """Tumbling counts by subject for continuous baselines, in update mode. No row is ever too late, unless ``late`` bounds
    the state by a watermark, which drops what is later."""
    rows = events.withWatermark(time, late) if late else events
    rows = rows.groupBy("stream_id", "template_id", F.window(time, window).alias("w")).count()
    return rows.select("stream_id", "template_id", F.col("w.start").alias("win_start"), F.col("count").alias("cnt"))


class Detector:
    """Continuous detection: each micro-batch adds its counts by window to a table, and the detectors run over the windows of the horizon.

    Counts are kept by batch, so a batch that runs again counts once; late events count in their own window. Insights of closed windows
    (all but the stream's last) that this batch changed or closed go to ``sink``; a window that late events change is told again.
    """

    def __init__(self, spark: SparkSession, path: str, settings: insights.Settings, sink: Callable[[DataFrame, int], None], *, time: str = "time", horizon: str = "30 days", detectors: tuple[Callable, ...] = (insights.spikes,)):
        self.spark, self.path, self.settings, self.sink, self.time, self.horizon, self.detectors = spark, path.rstrip("/"), settings, sink, time, horizon, detectors

    def batch(self, events: DataFrame, number: int) -> None:
        rows = events.filter(F.col(self.time).isNotNull()).groupBy(*insights.SUBJECT, F.window(self.time, self.settings.window)["start"].alias("win_start")).agg(F.count("*").alias("cnt"))
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        kind = T.StructType([*rows.schema, T.StructField("batch", T.LongType())])
        held = self.spark.read.schema(kind).option("basePath", self.path).parquet(f"{self.path}/batch=*").filter(F.col("batch") <= number)
        last = held.groupBy("stream_id").agg(F.max("win_start").alias("__last"))
        near = held.join(last, "stream_id").filter(F.col("win_start") > F.col("__last") - F.expr(f"interval {self.horizon}"))
        base = insights.baselines(insights.dense(near.groupBy(*insights.SUBJECT, "win_start").agg(F.sum("cnt").alias("cnt"), F.lit(0).alias("errors")), self.settings).drop("errors"), self.settings)
        # windows that the batch counts in, and the one that was open before it
        own = F.col("batch") == number
        changed = held.groupBy("stream_id").agg(F.least(F.min(F.when(own, F.col("win_start"))), F.max(F.when(~own, F.col("win_start")))).alias("__from"))
        found = None
        for detect in self.detectors:
            one = detect(base, self.settings)
            found = one if found is None else found.unionByName(one)
        self.sink(found.join(changed, "stream_id").join(last, "stream_id").filter((F.col("win_end") >= F.col("__from")) & (F.col("win_start") < F.col("__last"))).drop("__from", "__last"), number)

    def start(self, events: DataFrame, checkpoint: str, **trigger):
        write = events.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return write.trigger(**(trigger or {"availableNow": True})).start()


def seal_batches(store, events: DataFrame, checkpoint: str, **trigger):
    """Each micro-batch becomes the segment of its number: a batch that runs again writes the same segment once."""
    write = events.writeStream.foreachBatch(lambda rows, batch: store.seal(rows, segment=batch)).option("checkpointLocation", checkpoint)
    return write.trigger(**(trigger or {"availableNow": True})).start()
