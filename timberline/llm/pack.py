"""Best-fit packing: bounded-space online best-fit over a bitset of free space.

Each task holds at most ``open_bins`` sequences open. Bit f of an integer says
that some open sequence has f free places; a piece goes to the least such f that
holds it, and when too many are open the fullest is closed. What a task leaves
open at its end goes to a second, narrow round (piece numbers only, no texts), of
about ``round_tokens`` tokens a task, longest pieces first. Full pieces are
sequences by themselves. No text is shuffled.

Defined results: a null or empty text is its end token alone; null and repeated
doc_ids are packed row by row; very long texts are cut into pieces of
``max_tokens``, where the first may be shorter; an empty table gives no rows; no
column of the input but the two named is read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.cluster import lean, materialize

#: Texts of these characters alone, without long unbroken runs, get the same ids from the fast encoder.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
_UNBROKEN = re.compile(r"\S{2000}|\s{2000}")


class Encoder:
    """Ids of one tokenizer file; texts that need no special care go through a faster encoder of the same vocabulary."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        vocab = self.exact.get_vocab()
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        # byte-level vocabularies spell each byte as one character; the plain ones stand for themselves
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelt = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(spelt[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.fast = tiktoken.Encoding("fast", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if _PLAIN.fullmatch(text) and not _UNBROKEN.search(text) and not any(t in text for t in self.special):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


class BestFit:
    """Open sequences by free space; ``place`` tells sequence and offset, and gives back what it closed."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: dict[int, list[tuple[int, list]]] = {}

    def _take(self, free: int) -> tuple[int, list]:
        held = self.by_free[free]
        got = held.pop()
        self.count -= 1
        if not held:
            self.bits &= ~(1 << free)
        return got

    def _put(self, free: int, seq: tuple[int, list]) -> None:
        self.by_free.setdefault(free, []).append(seq)
        self.bits |= 1 << free
        self.count += 1

    def place(self, length: int, row: tuple) -> list[tuple[int, list]]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            free, seq = self.size, (self.made, [])
            self.made += 1
        seq[1].append((*row, self.size - free))
        if free == length:
            return [seq]
        self._put(free - length, seq)
        if self.count > self.open_bins:
            return [self._take((self.bits & -self.bits).bit_length() - 1)]
        return []

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.count:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


_COLUMNS = ["piece", "start", "length", "ids", "sequence_id", "offset", "left_open"]


def pack(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", max_tokens: int = 1024, end_id: int = 2, open_bins: int = 256, ids: str = "array", round_tokens: int = 4_000_000) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, sequence_id, offset, and ``ids`` as an array or,
    for ``ids="crc32"``, only the checksum ids_crc32 of the little-endian 32-bit ids."""
    ids_type, ids_name = ("array<int>", "ids") if ids == "array" else ("bigint", "ids_crc32")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, {ids_name} {ids_type}, sequence_id bigint, offset bigint, left_open boolean"
    payload: Callable = (lambda a: a) if ids == "array" else (lambda a: zlib.crc32(a.astype("<u4").tobytes()))
    arrow = {"piece": pa.int32(), "ids": pa.list_(pa.int32()) if ids == "array" else pa.int64(), "left_open": pa.bool_()}

    def batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        types = [key, *(arrow.get(c, pa.int64()) for c in _COLUMNS)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", *(ids_name if c == "ids" else c for c in _COLUMNS)])

    def rows_of(closed: list[tuple[int, list]], base: int, left: bool) -> list[tuple]:
        return [(*row[:5], base + seq, row[5], left) for seq, rows in closed for row in rows]

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, base, key = Encoder(tokenizer_path), BestFit(max_tokens, open_bins), TaskContext.get().partitionId() << 32, None
        out: list[tuple] = []
        for got in batches:
            key = got.schema.field(0).type
            for doc, value in zip(got.column(0), got.column(1), strict=True):
                tokens = np.array([*encode(value.as_py() or ""), end_id], dtype=np.int32)
                head = (len(tokens) - 1) % max_tokens + 1
                at = [0, *range(head, len(tokens), max_tokens), len(tokens)]
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    out += rows_of(bins.place(b - a, (doc.as_py(), k, a, b - a, payload(tokens[a:b]))), base, False)
                if len(out) >= 4096:
                    yield batch(out, key)
                    out = []
        out += rows_of(list(bins.rest()), base, True)
        if out:
            yield batch(out, key)

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base, key = BestFit(max_tokens, max(open_bins, 4096)), (1 << 62) + (TaskContext.get().partitionId() << 32), None
        out: list[tuple] = []
        for got in batches:
            key = got.schema.field(0).type
            for row in zip(*(got.column(i).to_pylist() for i in range(5)), strict=True):
                out += rows_of(bins.place(row[3], row), base, False)
            if out:
                yield batch(out, key)
                out = []
        out = rows_of(list(bins.rest()), base, False)
        if out:
            yield batch(out, key)

    placed = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(first_round), schema), "pack")
    left = placed.filter("left_open")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    order = [F.desc("length"), "doc_id", "piece", "start"]
    again = left.repartition(max(1, -(-tokens // round_tokens)), F.xxhash64("sequence_id", "offset")).sortWithinPartitions(*order).mapInArrow(lean(second_round), schema)
    return placed.filter("not left_open").union(again).drop("left_open")
