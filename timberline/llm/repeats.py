"""Substring deduplication by fixed-block anchors.

A run of ``width`` words that two texts share holds, in the one, a whole block of
``block`` words at a multiple of ``block`` (``width >= 2 * block - 1``), and the other
has that block at some place. So non-overlapping blocks are the index and every rolling
window of ``block`` words is a probe:

1. Each slice of texts sends, for each of P buckets of hash space, its windows' 32-bit
   hashes in text order, with a bit for those that are index blocks. A window that
   several documents of a slice share is an anchor already and is sent once, which
   keeps frequent passages small.
2. Each bucket finds the hashes that an index block has and at least two documents hold,
   and gives each document a bit map of its anchors.
3. Documents with anchors extend them: every run of ``width`` words around an anchor is
   sent with a hash of 128 bits, from two sets of word and step values, to find the least doc_id of each; runs
   of a greater doc_id are repeats. Overlapping runs join to maximal exact repeats.
4. The words of the repeats are cut out.

The first step's exchange is a little over four bytes a word, whatever the texts hold.

Defined results: a null text has no words; a null doc_id is greater than all others, so
those rows lose repeats and cause none; rows of one doc_id never cause each other's
removals; equal rows have equal results; an empty table gives no rows; of the
input only the two named columns are read. Ids are cast to 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm import kernels as K
from timberline.llm.cluster import BROADCAST_BYTES, broadcast_if, lean, materialize

_LAST = np.iinfo(np.int64).max
_SLICE = 4 << 20
_ROWS = "bucket int, docs binary, counts binary, bits binary, hashes binary"


def _by_bucket(bucket: np.ndarray, doc: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of windows by bucket, then place; and where each bucket begins."""
    order = np.argsort(bucket.astype(np.uint16 if n_buckets < 1 << 16 else np.int32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def _windows(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and word number in the row of each window of n words; and each row's first word."""
    s, e, at = K.find_words(buf, offs, K.NOT_SPACE)
    h = K.hash_windows(K.hash_words(buf, s, e), n)
    ok = np.flatnonzero(K.inside(at, n)) if len(h) else np.zeros(0, np.int64)
    row = np.searchsorted(at, ok, side="right") - 1
    return h[ok], row, ok - at[row], at


def _groups(h: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash (of one or two words), and the group number of each in that order."""
    order = np.argsort(h, kind="stable") if second is None else np.lexsort((second, h))
    if not len(h):
        return order, np.zeros(0, np.int64)
    x = h[order]
    new = x[1:] != x[:-1]
    if second is not None:
        y = second[order]
        new |= y[1:] != y[:-1]
    return order, np.cumsum(np.r_[False, new])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    raw, offs = K.buffers(batch.column("text"))
    for lo, hi in K.row_slices(offs, _SLICE):
        yield raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo, hi


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)


def _pack(columns: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _send_probes(n: int, n_buckets: int):
    """Step 1. bits holds, one after the other: known (anchor within the slice), sent, block."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = _ids(batch), batch.column("mark").to_numpy()
            for buf, offs, lo, _ in _slices(batch):
                h, row, place, _ = _windows(buf, offs, n)
                if not len(h):
                    continue
                block = place % n == 0
                order, group = _groups(h)
                doc = ids[lo + row]
                # groups with more than one document: known; their first stands for all
                sorted_doc = doc[order]
                first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                several = np.minimum.reduceat(sorted_doc, first) != np.maximum.reduceat(sorted_doc, first)
                known = np.empty(len(h), dtype=bool)
                known[order] = several[group]
                sent = ~known
                sent[order[first[several]]] = True
                block[order[first]] |= (np.add.reduceat(block[order].astype(np.int64), first) > 0) & several
                bucket = ((h >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
                low = h.astype(np.uint32)
                order, begin = _by_bucket(bucket, row, n_buckets)
                out: list[list] = [[], [], [], [], []]
                for b in range(n_buckets):
                    at = order[begin[b] : begin[b + 1]]
                    if not len(at):
                        continue
                    head = np.flatnonzero(np.r_[True, row[at[1:]] != row[at[:-1]]])
                    rows = lo + row[at[head]]
                    out[0].append(b)
                    out[1].append(np.concatenate([ids[rows], marks[rows]]).tobytes())
                    out[2].append(np.diff(np.r_[head, len(at)]).astype(np.uint32).tobytes())
                    out[3].append(b"".join(np.packbits(x[at]).tobytes() for x in (known, sent, block)))
                    out[4].append(low[at][sent[at]].tobytes())
                yield _pack(out, ["bucket", "docs", "counts", "bits", "hashes"], [pa.int32(), *[pa.binary()] * 4])

    return send


class _Bucket:
    """The rows of one bucket, as they come."""

    def __init__(self):
        self.docs, self.marks, self.counts, self.bits, self.hashes = [], [], [], [], []

    def add(self, docs: bytes, counts: bytes, bits: bytes, hashes: bytes, kind: type) -> None:
        d = np.frombuffer(docs, np.int64)
        c = np.frombuffer(counts, np.uint32)
        self.docs.append(d[: len(c)])
        self.marks.append(d[len(c) :])
        self.counts.append(c)
        self.bits.append(bits)
        self.hashes.append(np.frombuffer(hashes, kind))


def _per_bucket(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[int, _Bucket]]:
    """Buckets of a partition sorted by bucket."""
    now, held = None, _Bucket()
    for batch in batches:
        for b, *row in zip(*(batch.column(c) for c in ("bucket", "docs", "counts", "bits", "hashes")), strict=True):
            b = b.as_py()
            if b != now:
                if now is not None:
                    yield now, held
                now, held = b, _Bucket()
            held.add(*(x.as_py() for x in row), kind)
    if now is not None:
        yield now, held


_ANSWERS = "part int, bucket int, docs binary, counts binary, payload binary"


def _answers(bucket: int, docs: np.ndarray, marks: np.ndarray, payload: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    """A bucket's answers to documents, one row for each part of the documents."""
    part = (K.mix((docs ^ marks).view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    out: list[list] = [[], [], [], [], []]
    for i, j in zip(edge, np.r_[edge[1:], len(order)], strict=True):
        at = order[i:j]
        mine = [payload[k] for k in at]
        for to, x in zip(out, (int(part[at[0]]), bucket, np.concatenate([docs[at], marks[at]]).tobytes(), np.array([len(x) for x in mine], np.uint32).tobytes(), b"".join(mine)), strict=True):
            to.append(x)
    if out[0]:
        yield _pack(out, ["part", "bucket", "docs", "counts", "payload"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])


def _per_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """doc_id, mark, bucket and payload of all answers of each part, of rows sorted by part."""
    now, held = None, None

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        return np.concatenate(held[0]), np.concatenate(held[1]), np.concatenate(held[2]), held[3]

    for batch in batches:
        for part, bucket, docs, counts, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now:
                if held:
                    yield whole()
                now, held = part, ([], [], [], [])
            n = np.frombuffer(counts, np.uint32).tolist()
            d, at = np.frombuffer(docs, np.int64), 0
            held[0].append(d[: len(n)])
            held[1].append(d[len(n) :])
            held[2].append(np.full(len(n), bucket, np.int32))
            for k in n:
                held[3].append(payload[at : at + k])
                at += k
    if held:
        yield whole()


def _documents(docs: np.ndarray, marks: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each document in an order by doc_id and mark."""
    d, m = docs[order], marks[order]
    begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (m[1:] != m[:-1])])
    return begin, np.r_[begin[1:], len(order)]


def _find_anchors(parts: int):
    """Step 2."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, held in _per_bucket(batches, np.uint32):
            known, sent, block = [], [], []
            for bits, c in zip(held.bits, held.counts, strict=True):
                n, step = int(c.sum()), -(-int(c.sum()) // 8)
                raw = np.frombuffer(bits, np.uint8)
                for i, to in enumerate((known, sent, block)):
                    to.append(np.unpackbits(raw[i * step : (i + 1) * step], count=n).astype(bool))
            docs, marks, counts = (np.concatenate(x) for x in (held.docs, held.marks, held.counts))
            anchor, sent, block = (np.concatenate(x) for x in (known, sent, block))
            hashes = np.concatenate(held.hashes)
            owner = np.repeat(np.arange(len(docs)), counts)[sent]
            index = np.unique(hashes[block[sent]])
            if len(index):
                at = np.minimum(np.searchsorted(index, hashes), len(index) - 1)
                hit = np.flatnonzero(index[at] == hashes)
                at, doc = at[hit], docs[owner[hit]]
                least, most = np.full(len(index), _LAST), np.full(len(index), np.iinfo(np.int64).min)
                np.minimum.at(least, at, doc)
                np.maximum.at(most, at, doc)
                # a window that stands for several documents of its slice makes two of any other's one
                shared = least != most
                shared[at[anchor[sent][hit]]] = True
                anchor[np.flatnonzero(sent)[hit[shared[at]]]] = True
            begin = np.r_[0, np.cumsum(counts, dtype=np.int64)]
            some = np.flatnonzero(np.add.reduceat(anchor.astype(np.int64), begin[:-1]))
            yield from _answers(b, docs[some], marks[some], [np.packbits(anchor[begin[i] : begin[i + 1]]).tobytes() for i in some], parts)

    return find


def _gather_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, end: a document's buckets and bit maps."""
    for docs, marks, buckets, bits in _per_part(batches):
        order = np.lexsort((buckets, marks, docs))
        begin, end = _documents(docs, marks, order)
        for k in range(0, len(begin), 4096):
            b, e = begin[k : k + 4096], end[k : k + 4096]
            yield _pack([docs[order[b]], marks[order[b]], [buckets[order[i:j]].tobytes() for i, j in zip(b, e, strict=True)], [b"".join(bits[x] for x in order[i:j]) for i, j in zip(b, e, strict=True)]], ["key", "mark", "buckets", "bits"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])


def _send_runs(n: int, width: int, n_buckets: int):
    """Step 3, first half. bits holds one bit: repeat within the slice; hashes and places only of the others."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = _ids(batch), batch.column("mark").to_numpy()
            hits, maps = batch.column("buckets"), batch.column("bits")
            for buf, offs, lo, hi in _slices(batch):
                h, row, place, at = _windows(buf, offs, n)
                bucket = ((h >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
                anchor = np.zeros(len(h), dtype=bool)
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    mine = bucket[edge[r] : edge[r + 1]]
                    order = np.argsort(mine, kind="stable")
                    ends = mine[order]
                    bits, used = np.frombuffer(maps[lo + r].as_py(), np.uint8), 0
                    for x in np.frombuffer(hits[lo + r].as_py(), np.int32):
                        a, z = np.searchsorted(ends, [x, x + 1])
                        step = -(-int(z - a) // 8)
                        on = np.unpackbits(bits[used : used + step], count=z - a).astype(bool)
                        used += step
                        anchor[edge[r] + order[a:z][on]] = True
                # runs of `width` words that hold an anchor
                words = int(at[-1])
                mark_at = np.zeros(words + 1, dtype=np.int64)
                np.add.at(mark_at, at[row[anchor]] + place[anchor] + 1, 1)
                seen = np.cumsum(mark_at)
                s, e, _ = K.find_words(buf, offs, K.NOT_SPACE)
                full = K.hash_windows(K.hash_words(buf, s, e), width)
                full2 = K.hash_windows(K.hash_words(buf, s, e, second=True), width, second=True)
                starts = np.flatnonzero(K.inside(at, width)) if len(full) else np.zeros(0, np.int64)
                starts = starts[seen[starts + width - n + 1] > seen[starts]]
                if not len(starts):
                    continue
                run, run2 = full[starts], full2[starts]
                row = np.searchsorted(at, starts, side="right") - 1
                doc = ids[lo + row]
                order, group = _groups(run, run2)
                first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                least = np.minimum.reduceat(doc[order], first)
                repeat = np.empty(len(run), dtype=bool)
                repeat[order] = doc[order] > least[group]
                # of equal runs of the least document one asks for all
                bucket = ((run >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
                order, begin = _by_bucket(bucket, row, n_buckets)
                out: list[list] = [[], [], [], [], []]
                offset = (starts - at[row]).astype(np.uint32)
                for b in range(n_buckets):
                    o = order[begin[b] : begin[b + 1]]
                    if not len(o):
                        continue
                    head = np.flatnonzero(np.r_[True, row[o[1:]] != row[o[:-1]]])
                    rows = lo + row[o[head]]
                    ask = o[~repeat[o]]
                    out[0].append(b)
                    out[1].append(np.concatenate([ids[rows], marks[rows]]).tobytes())
                    out[2].append(np.diff(np.r_[head, len(o)]).astype(np.uint32).tobytes())
                    out[3].append(np.packbits(repeat[o]).tobytes() + offset[o].tobytes())
                    out[4].append(np.column_stack([run[ask], run2[ask]]).tobytes())
                yield _pack(out, ["bucket", "docs", "counts", "bits", "hashes"], [pa.int32(), *[pa.binary()] * 4])

    return send


def _find_repeats(parts: int):
    """Step 3, second half: the starts of repeated runs by document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, held in _per_bucket(batches, np.uint64):
            repeat, places = [], []
            for bits, c in zip(held.bits, held.counts, strict=True):
                n, step = int(c.sum()), -(-int(c.sum()) // 8)
                raw = np.frombuffer(bits, np.uint8)
                repeat.append(np.unpackbits(raw[:step], count=n).astype(bool))
                places.append(raw[step:].copy().view(np.uint32))
            docs, marks, counts = (np.concatenate(x) for x in (held.docs, held.marks, held.counts))
            repeat, places, hashes = np.concatenate(repeat), np.concatenate(places), np.concatenate(held.hashes).reshape(-1, 2)
            asked = np.flatnonzero(~repeat)
            doc = docs[np.repeat(np.arange(len(docs)), counts)[asked]]
            order, group = _groups(hashes[:, 0], hashes[:, 1])
            if len(order):
                first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                least = np.minimum.reduceat(doc[order], first)
                repeat[asked[order]] = doc[order] > least[group]
            begin = np.r_[0, np.cumsum(counts, dtype=np.int64)]
            some = np.flatnonzero(np.add.reduceat(repeat.astype(np.int64), begin[:-1]))
            yield from _answers(b, docs[some], marks[some], [places[begin[i] : begin[i + 1]][repeat[begin[i] : begin[i + 1]]].tobytes() for i in some], parts)

    return find


def _gather_runs(width: int):
    """Step 3, end: overlapping or touching runs of a document become one, as pairs of begin and end."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, marks, _, starts in _per_part(batches):
            order = np.lexsort((marks, docs))
            begin, end = _documents(docs, marks, order)
            for k in range(0, len(begin), 4096):
                b, e = begin[k : k + 4096], end[k : k + 4096]
                runs = []
                for i, j in zip(b, e, strict=True):
                    at = np.unique(np.frombuffer(b"".join(starts[x] for x in order[i:j]), np.uint32))
                    cut = np.flatnonzero(np.diff(at) > width)
                    runs.append(np.column_stack([at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + np.uint32(width)]).astype(np.uint32).tobytes())
                yield _pack([docs[order[b]], marks[order[b]], runs], ["key", "mark", "runs"], [pa.int64(), pa.int64(), pa.binary()])

    return gather


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4."""
    for batch in batches:
        _, offs = K.buffers(batch.column("text"))
        for lo, hi in K.row_slices(offs):
            texts, runs = batch.column("text"), batch.column("runs")
            kept, n_words, n_removed = [], [], []
            for i in range(lo, hi):
                words = (texts[i].as_py() or "").encode().split()
                n_words.append(len(words))
                at, stay = 0, []
                for begin, end in np.frombuffer(runs[i].as_py() or b"", np.uint32).reshape(-1, 2).tolist():
                    stay += words[at:begin]
                    at = end
                words = stay + words[at:] if at else words
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 13, block: int = 7, bucket_bytes: int = 128 << 20, most_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one blank) of each row."""
    if width < 2 * block - 1:
        raise ValueError("a shared run must hold a whole block: width >= 2 * block - 1")
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        return rows.repartition(buckets, by).sortWithinPartitions(by)

    def answered(rows: DataFrame, find, gather, kind: str) -> DataFrame:
        found = dealt(rows, "bucket").mapInArrow(lean(find), _ANSWERS)
        return materialize(dealt(found, "part").mapInArrow(lean(gather), kind), "repeats")

    hits = answered(base.mapInArrow(lean(_send_probes(block, buckets)), _ROWS), _find_anchors(buckets), _gather_anchors, "key bigint, mark bigint, buckets binary, bits binary")
    keyed = base.withColumn("key", F.coalesce("doc_id", F.lit(int(_LAST))))
    names = hits.select("key", "mark")
    some = keyed.join(F.broadcast(names), ["key", "mark"], "left_semi") if 24 * hits.count() <= most_broadcast else keyed
    with_hits = some.join(hits.hint("shuffle_merge"), ["key", "mark"]).select("doc_id", "text", "mark", "buckets", "bits")
    repeats = answered(with_hits.mapInArrow(lean(_send_runs(block, width, buckets)), _ROWS), _find_repeats(buckets), _gather_runs(width), "key bigint, mark bigint, runs binary")
    last = broadcast_if(repeats, most_broadcast)
    whole = keyed.join(last, ["key", "mark"], "left").select("doc_id", "text", "runs")
    return whole.mapInArrow(lean(_cut), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
