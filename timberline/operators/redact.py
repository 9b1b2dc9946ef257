"""Redaction of raw lines before anything else sees them."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Built-in classes in their fixed order; the patterns are this engine's own.
BUILT_IN = [
    ("api_key", r"AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|(?:api_key|apikey|token) ?= ?\"?[A-Za-z0-9_-]{16,}\"?"),
    ("bearer_token", r"[Bb]earer [A-Za-z0-9._~+/-]{8,}=*"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("card_number", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"),
]


def placeholder(name: str) -> str:
    return f"[REDACTED:{name}]"


def chain(custom: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Built-in classes, then custom ones; a pattern that is no regular expression is refused here, before any line is read."""
    for _, pattern in custom or []:
        re.compile(pattern)
    return [*BUILT_IN, *(custom or [])]


def redact(raw: Column, classes: list[tuple[str, str]] | None = None) -> Column:
    """The admitted line: every match of each class, in order, replaced by its placeholder."""
    for name, pattern in classes or BUILT_IN:
        raw = F.regexp_replace(raw, pattern, placeholder(name))
    return raw


def counts(raw: Column, classes: list[tuple[str, str]] | None = None) -> dict[str, Column]:
    """Matches of each class in the text that its stage of the chain sees; never the text."""
    out = {}
    for name, pattern in classes or BUILT_IN:
        out[name] = F.coalesce(F.regexp_count(raw, F.lit(pattern)), F.lit(0))
        raw = F.regexp_replace(raw, pattern, placeholder(name))
    return out


def totals(lines: DataFrame, classes: list[tuple[str, str]] | None = None, *, raw: str = "raw") -> DataFrame:
    """class and n over all lines, in one pass."""
    each = counts(F.col(raw), classes)
    sums = lines.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in each.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("class"), F.col(n).cast("bigint").alias("n")) for n in each))).alias("x")).select("x.*")


def plugged(lines: DataFrame, redactor: Callable[[str], str], *, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(admitted, withheld): a redactor in Python runs in Arrow batches; a line on which it fails is withheld
    with the error's type, and its text goes nowhere."""

    @F.pandas_udf("ok boolean, text string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((True, None if t is None else redactor(t), None))
            except Exception as e:  # noqa: BLE001  fail safe: the line is held back
                rows.append((False, None, type(e).__name__))
        return pd.DataFrame(rows, columns=["ok", "text", "error"])

    others = [c for c in lines.columns if c != raw]
    done = lines.withColumn("__r", run(F.col(raw)))
    return done.filter("__r.ok").select(*others, F.col("__r.text").alias(raw)), done.filter("not __r.ok").select(*others, F.col("__r.error").alias("error"))


def sql_redact(raw: str) -> str:
    for name, pattern in BUILT_IN:
        p = pattern.replace("'", "''")
        raw = f"regexp_replace({raw}, '{p}', '{placeholder(name)}', 'g')"
    return raw


def sql_counts(raw: str) -> dict[str, str]:
    out = {}
    for name, pattern in BUILT_IN:
        p = pattern.replace("'", "''")
        out[name] = f"coalesce(len(regexp_extract_all({raw}, '{p}')), 0)"
        raw = f"regexp_replace({raw}, '{p}', '{placeholder(name)}', 'g')"
    return out
