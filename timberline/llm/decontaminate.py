"""Benchmark decontamination: a broadcast hash set of benchmark word windows.

A text's words are runs of digits, a-z (after lower-casing A-Z) and bytes beyond
ASCII. Each benchmark item gives its windows of ``width`` words, or one shorter
window if it has fewer words. Training texts are scanned window by window in
Arrow batches: hash, bitmap, sorted hash list, then an exact comparison of the
words. There is no shuffle. The index is built once on the driver, of at most
``shard_bytes`` of benchmark text at a time, and broadcast (some seven bytes a byte of text); a larger
benchmark takes several passes, with the spans found so far written to the shared folder between passes.

Defined results: null or wordless texts have no words and no hits; null or
wordless items have no windows; rows repeat as they come; items that share an
item_id count once; an item without id marks words but is not listed; an input
column named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm import kernels as K
from timberline.llm.cluster import lean, materialize

SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
_BITS = 22


class WindowIndex:
    """The windows of some items in flat arrays, so that it is built once and broadcast: the items' words parted by
    blanks, where each begins and ends, and by window length a bitmap, the sorted hashes, and the first word and item of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.names = sorted({i for i, _ in items if i is not None})
        buf, offs = K.buffers(pa.array([t for _, t in items], pa.string()))
        buf = K.LOWER[buf]
        s, e, at = K.find_words(buf, offs, K.ALNUM)
        words = K.hash_words(buf, s, e)
        # words moved together, one blank between two
        sizes = e - s
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.begin + sizes
        self.text = np.full(int(self.end[-1]) + 1 if len(s) else 0, 32, np.uint8)
        joined = np.ones(len(self.text), dtype=bool)
        joined[self.end] = False
        self.text[joined] = buf[K.ALNUM[buf]]
        number = {name: k for k, name in enumerate(self.names)}
        owner = np.array([-1 if i is None else number[i] for i, _ in items], np.int32)
        counts = np.diff(at)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({int(x) for x in np.minimum(counts, width) if x}):
            mine = np.flatnonzero(np.minimum(counts, width) == n)
            first = np.concatenate([np.arange(at[k], at[k + 1] - n + 1) for k in mine])
            item = np.repeat(owner[mine], counts[mine] - n + 1)
            h = K.hash_windows(words, n)[first]
            order = np.lexsort((first, item, h))
            h, first, item = h[order], first[order].astype(np.int32 if len(s) < 1 << 31 else np.int64), item[order]
            # an item's window that it holds again says nothing new
            new = np.r_[True, (h[1:] != h[:-1]) | (item[1:] != item[:-1])]
            for k in np.flatnonzero(~new):
                new[k] = self._words(int(first[k]), n) != self._words(int(first[k - 1]), n)
            bitmap = np.zeros(1 << _BITS, dtype=bool)
            bitmap[h >> np.uint64(64 - _BITS)] = True
            self.by_length[n] = (bitmap, h[new], first[new], item[new])

    def _words(self, first: int, n: int) -> bytes:
        return self.text[self.begin[first] : self.end[first + n - 1]].tobytes()

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.text, self.begin, self.end)) + sum(x.nbytes for held in self.by_length.values() for x in held)

    def hits(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """(first word, length, item ids) of each occurrence, in the lower-cased buffer."""
        words = K.hash_words(buf, s, e)
        for n, (bitmap, known, first, item) in self.by_length.items():
            h = K.hash_windows(words, n)
            i = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITS)])
            i = i[K.inside(at, n)[i]]
            lo, hi = (np.searchsorted(known, h[i], side=side) for side in ("left", "right"))
            for p, a, b in zip(i[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                here = b" ".join(buf[x:y].tobytes() for x, y in zip(s[p : p + n], e[p : p + n], strict=True))
                same = [k for k in range(a, b) if self._words(int(first[k]), n) == here]
                if same:
                    yield p, n, {self.names[item[k]] if item[k] >= 0 else None for k in same}


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _strip(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and what stands between them."""
    raw = text.encode()
    buf = K.LOWER[np.frombuffer(raw, dtype=np.uint8)]
    s, e, _ = K.find_words(buf, np.array([0, len(buf)]), K.ALNUM)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : s[a]])
        at = int(e[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def _shards(benchmark: DataFrame, item: str, text: str, shard_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark in lists of about ``shard_bytes`` of text, one on the driver at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // shard_bytes) or 1
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, shard_bytes: int = 32 << 20, cleaned: str | None = None) -> DataFrame:
    """The columns ``keep`` of each row, with n_words, spans of hit words (word numbers, merged), and the
    ids of the items hit as sorted strings; ``cleaned`` names a column for the text without its hit words."""
    spark = docs.sparkSession
    keep = [c for c in keep if c not in {"n_words", "spans", "items", cleaned}]
    df = docs.select(*keep, F.col(text).alias("__text")).withColumns({"spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
    shards = _shards(benchmark, item_id, item_text, shard_bytes)
    rows = next(shards)
    while rows is not None:
        ahead = next(shards, None)
        df = _scan(df, spark.sparkContext.broadcast(WindowIndex(rows, width)), keep, ahead is None, cleaned)
        if ahead is not None:
            df = materialize(df, "decontaminate")
        rows = ahead
    return df


def _scan(df: DataFrame, shared, keep: list[str], final: bool, cleaned: str | None) -> DataFrame:
    fields = [df.schema[c] for c in keep]
    if final:
        fields += [T.StructField("n_words", T.LongType())]
    else:
        fields += [T.StructField("__text", T.StringType())]
    fields += [df.schema["spans"], df.schema["items"]]
    if final and cleaned:
        fields.append(T.StructField(cleaned, T.StringType()))
    schema = T.StructType(fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            raw, offs = K.buffers(batch.column("__text"))
            for lo, hi in K.row_slices(offs):
                part = batch.slice(lo, hi - lo)
                buf, places = K.LOWER[raw[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
                s, e, at = K.find_words(buf, places, K.ALNUM)
                spans, ids = part.column("spans").to_pylist(), part.column("items").to_pylist()
                spans = [[(x["begin"], x["end"]) for x in r] for r in spans]
                for p, n, found in index.hits(buf, s, e, at):
                    k = int(np.searchsorted(at, p, side="right")) - 1
                    spans[k].append((p - int(at[k]), p - int(at[k]) + n))
                    ids[k] = ids[k] + [x for x in found if x is not None and x not in ids[k]]
                spans = [_merge(r) for r in spans]
                cols = [part.column(c) for c in keep]
                cols.append(pa.array(np.diff(at)) if final else part.column("__text"))
                cols.append(pa.array([[{"begin": a, "end": b} for a, b in r] for r in spans], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))
                cols.append(pa.array([sorted(r) for r in ids], pa.list_(pa.string())))
                if final and cleaned:
                    texts = part.column("__text")
                    cols.append(pa.array([_strip(texts[i].as_py(), r) if r else texts[i].as_py() for i, r in enumerate(spans)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(lean(scan), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated rows (mode ``documents``), or with their hit words cut out (``spans``)."""
    others = [c for c in docs.columns if c != text]
    if mode == "spans":
        out = contamination(docs, benchmark, keep=others, text=text, cleaned=text, **options)
        return out.select(*docs.columns)
    if mode != "documents":
        raise ValueError(f"no such mode: {mode}")
    held = docs.withColumn("__whole", F.struct(*docs.columns))
    out = contamination(held.select("__whole", F.col(text).alias("__scan")), benchmark, keep=["__whole"], text="__scan", **options)
    return out.filter(F.size("spans") == 0).select("__whole.*")
