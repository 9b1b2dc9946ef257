"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; runs of anything but letters become one blank; n-grams of 1
to ``max_n`` characters hash into ``1 << bits`` buckets. Training counts buckets by
language over a bounded sample, at most about ``rows_per_language`` labelled rows of
each language chosen by a hash of the id (in expectation; the share is the bound over
the language's count). The log-probabilities, buckets by languages, are broadcast;
batches are scored with numpy by gathering rows and summing them by text. Every
text is scored whole. Languages weigh the same, whatever their share of the rows. More than
``most_languages`` are trained and scored in groups, one matrix at a time, with the same results.

The posterior is closed: it also nears 1 for texts in none of the languages. ``fit_out`` adds an absolute
measure: how far a text's mean log-probability an n-gram lies from that of evenly strewn buckets (0) to
that of the winning language's own texts (1, the negative entropy of its model).

Defined results: null texts and texts without a letter are ``und`` with score 0, and
so is everything if no row is labelled; ties go to the first language in code point
order; rows with null text, language or id do not train; columns of the input that
are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.cluster import lean, materialize

UNKNOWN = "und"
MOST_LANGUAGES = 500
Model = tuple[list[str], np.ndarray]
_SLICE = 1 << 19


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points of the first plane are letters."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def grams(texts: list[str], max_n: int, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n the text numbers (sorted) and buckets of all n-grams; and which texts have a letter."""
    low = [t.lower() for t in texts]
    chars = np.frombuffer("".join(low).encode("utf-32-le"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    letter = _letters()[np.minimum(chars, 0xFFFF)]
    far = np.flatnonzero(chars > 0xFFFF)
    letter[far] = [chr(c).isalpha() for c in chars[far]]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])
    chars, doc, letter = np.where(letter, chars, 32)[keep], doc[keep], letter[keep]
    has = np.zeros(len(low), dtype=bool)
    has[doc[letter]] = True
    out = []
    h = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, max_n + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(1)
        ok = doc[:m] == doc[n - 1 :]
        if n == 1:
            ok &= letter
        out.append((doc[:m][ok], ((h[ok] * np.uint64(0xD1342543DE82EF95 + 2 * n)) >> np.uint64(64 - bits)).astype(np.int32)))
    return out, has


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _SLICE:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def train(docs: DataFrame, *, key: Column, text: str = "text", lang: str = "lang", rows_per_language: int = 8000, max_n: int = 4, bits: int = 16, alpha: float = 0.5, most_languages: int = MOST_LANGUAGES) -> Model | list[Model]:
    """Languages, sorted, and float32 log-probabilities (buckets by languages); a list of these beyond ``most_languages``.
    ``key`` is the id that samples."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & key.isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), key.alias("key"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((1 << bits, 0), dtype=np.float32)
    parts = [langs[k : k + most_languages] for k in range(0, len(langs), most_languages)]
    models = [_train(rows if len(parts) == 1 else rows.filter(F.col("lang").isin(part)), part, counts, rows_per_language, max_n, bits, alpha) for part in parts]
    return models[0] if len(models) == 1 else models


def _train(rows: DataFrame, langs: list[str], counts: dict[str, int], rows_per_language: int, max_n: int, bits: int, alpha: float) -> Model:
    share = F.create_map(*(F.lit(x) for name in langs for x in (name, min(1.0, rows_per_language / counts[name]))))
    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * float(1 << 40))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) << bits, dtype=np.int64)
        place = {name: i for i, name in enumerate(langs)}
        for batch in batches:
            names, texts = (batch.column(i).to_pylist() for i in (0, 1))
            for lo, hi in _slices(texts):
                base = np.array([place[x] << bits for x in names[lo:hi]], dtype=np.int64)
                for doc, bucket in grams(texts[lo:hi], max_n, bits)[0]:
                    total += np.bincount(base[doc] + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)]), pa.array(total[at[k : k + (1 << 16)]])], names=["cell", "n"])

    cells = sample.select("lang", "text").mapInArrow(lean(count), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(langs) << bits)
    seen[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    seen = seen.reshape(len(langs), 1 << bits) + alpha
    return langs, np.ascontiguousarray(np.log(seen / seen.sum(axis=1, keepdims=True)).T.astype(np.float32))


def score(texts: list[str], matrix: np.ndarray, max_n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summed log-probabilities, texts by languages; which texts have a letter; and their numbers of n-grams."""
    total, n_grams = np.zeros((len(texts), matrix.shape[1])), np.zeros(len(texts), dtype=np.int64)
    has = np.zeros(len(texts), dtype=bool)
    block = max(1024, (1 << 21) // max(1, matrix.shape[1]))
    for lo, hi in _slices(texts):
        found, has[lo:hi] = grams(texts[lo:hi], max_n, bits)
        for doc, bucket in found:
            n_grams[lo:hi] += np.bincount(doc, minlength=hi - lo)
            for k in range(0, len(doc), block):
                d = doc[k : k + block]
                first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                total[lo + d[first]] += np.add.reduceat(matrix[bucket[k : k + block]], first, axis=0, dtype=np.float64)
    return total, has, n_grams


def scale(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each language's mean log-probability over evenly strewn buckets, and over n-grams of its own."""
    even, own = np.empty(matrix.shape[1]), np.empty(matrix.shape[1])
    for k in range(matrix.shape[1]):
        p = matrix[:, k].astype(np.float64)
        even[k], own[k] = p.mean(), (np.exp(p) * p).sum()
    return even, own


def identify(docs: DataFrame, model: Model | list[Model], *, keep: list[str], text: str = "text", lang_out: str = "lang_pred", score_out: str = "score", fit_out: str | None = None, max_n: int = 4, bits: int = 16) -> DataFrame:
    """The columns ``keep``, then the predicted language and its posterior, and the fit if ``fit_out`` names a column for it."""
    models = model if isinstance(model, list) else [model]
    keep = [c for c in keep if c not in (lang_out, score_out, fit_out)]
    rows = docs.select(*keep, F.col(text).alias("__text"), F.lit(None).cast("string").alias("__lang"), F.lit(0.0).alias("__top"), F.lit(0.0).alias("__rest"), F.lit(0.0).alias("__fit"))
    for k, one in enumerate(models):
        rows = _score_group(rows, one, keep, max_n, bits)
        if k < len(models) - 1:
            rows = materialize(rows, "languages")
    known = F.col("__lang").isNotNull()
    out = [F.coalesce("__lang", F.lit(UNKNOWN)).alias(lang_out), F.when(known, 1 / F.col("__rest")).otherwise(0.0).alias(score_out)]
    return rows.select(*keep, *out, *([F.when(known, F.col("__fit")).otherwise(0.0).alias(fit_out)] if fit_out else []))


def _score_group(rows: DataFrame, model: Model, keep: list[str], max_n: int, bits: int) -> DataFrame:
    """The best language so far: its log-probability, the sum of all languages' relative to it, and its fit."""
    held = rows.sparkSession.sparkContext.broadcast((*model, *scale(model[1])))
    state = ["__lang", "__top", "__rest", "__fit"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, even, own = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            names = batch.column("__lang").to_pylist()
            top, rest, fit = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in state[1:])
            if langs and texts:
                total, has, n = score(texts, matrix, max_n, bits)
                best = total.argmax(axis=1)
                high = total.max(axis=1)
                mine = np.exp(total - high[:, None]).sum(axis=1)
                for i in np.flatnonzero(has):
                    b = best[i]
                    # of equal ones the first name stays
                    if names[i] is None or high[i] > top[i]:
                        before = 0.0 if names[i] is None else rest[i] * np.exp(top[i] - high[i])
                        names[i], top[i], rest[i] = langs[b], high[i], mine[i] + before
                        fit[i] = (high[i] / n[i] - even[b]) / max(own[b] - even[b], 1e-9)
                    else:
                        rest[i] += mine[i] * np.exp(high[i] - top[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "__text")), pa.array(names, pa.string()), pa.array(top), pa.array(rest), pa.array(fit)], names=[*keep, "__text", *state])

    schema = rows.schema
    for f in schema.fields[-4:]:
        f.nullable = True
    return rows.mapInArrow(lean(predict), schema)
