"""FNV-1a with 64 bits: as a native expression, and vectorised over Arrow batches.

ANSI arithmetic does not wrap, so the native form keeps two 32-bit halves.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values
BASIS = 0xCBF29CE484222325
PRIME = 0x100000001B3
SEPARATOR = "\x1e"
_HALF = (1 << 32) - 1


def fnv1a(data: bytes, state: int = BASIS) -> int:
    for b in data:
        state = (state ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return state


def fnv_hex(text: Column) -> Column:
    """The hash of a string's UTF-8 bytes as 16 hex digits, in built-in expressions."""
    digits = F.hex(F.encode(text, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    octets = F.when(F.octet_length(text) > 0, octets).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(BASIS >> 32).cast("bigint").alias("hi"), F.lit(BASIS & _HALF).cast("bigint").alias("lo"))

    def step(acc: Column, b: Column) -> Column:
        low = acc["lo"].bitwiseXOR(b)
        product = low * 435
        high = (acc["hi"] * 435 + F.shiftright(product, 32) + low * 256).bitwiseAND(_HALF)
        return F.struct(high.alias("hi"), product.bitwiseAND(_HALF).alias("lo"))

    return F.aggregate(octets, start, step, lambda acc: F.lower(F.concat(F.lpad(F.hex(acc["hi"]), 8, "0"), F.lpad(F.hex(acc["lo"]), 8, "0"))))


def fnv_batch(texts: Iterable[str | None]) -> np.ndarray:
    """Hashes of many strings, one byte position of all of them at a time."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw])
    order = np.argsort(-sizes, kind="stable")
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    begin = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    state = np.full(len(raw), BASIS, dtype=np.uint64)
    for k in range(int(sizes[0]) if len(raw) else 0):
        n = int(np.searchsorted(-sizes, -k, side="left"))
        state[:n] = (state[:n] ^ buf[begin[:n] + k]) * np.uint64(PRIME)
    out = np.empty_like(state)
    out[order] = state
    return out


@F.pandas_udf(T.LongType())
def fnv_long(texts: pd.Series) -> pd.Series:
    """The hash's bit pattern as a signed number."""
    return pd.Series(fnv_batch(texts).view(np.int64))


def fingerprint(tokens: Column) -> Column:
    """An event's fingerprint: the hash of its masked tokens, parted by 0x1E."""
    return fnv_long(F.array_join(tokens, SEPARATOR))


def template_set_hash(patterns: list[str]) -> int:
    """The hash of the distinct patterns in byte order, each ended by a line feed."""
    return fnv1a(b"".join(p + b"\n" for p in sorted({p.encode() for p in patterns})))


def sql_fnv_ctes(source: str, key: str, text: str, name: str = "fnv1a") -> str:
    """DuckDB CTEs, to follow on WITH RECURSIVE, of which ``name`` has rows (k, fnv) with 16 hex digits for each row of ``source``; every key must be unique."""
    return f"""
{name}_src AS MATERIALIZED (SELECT {key} AS k, hex(encode({text})) AS h FROM {source}),
{name}_run(k, h, i, s) AS (
    SELECT k, h, 1, CAST({BASIS} AS HUGEINT) FROM {name}_src
    UNION ALL
    SELECT k, h, i + 2, (xor(s, CAST(CAST('0x' || substr(h, i, 2) AS INTEGER) AS HUGEINT)) * {PRIME}) % CAST(18446744073709551616 AS HUGEINT) FROM {name}_run WHERE i < length(h)),
{name} AS MATERIALIZED (SELECT k, lower(printf('%016x', CAST(s AS UBIGINT))) AS fnv FROM {name}_run WHERE i >= length(h))"""


def sql_fnv(source: str, key: str, text: str) -> str:
    return f"WITH RECURSIVE {sql_fnv_ctes(source, key, text)} SELECT k, fnv FROM fnv1a"
