import random

import numpy as np
import pyarrow as pa
import pytest

from timberline.llm import kernels as K
from timberline.llm import repeats


def brute(rows, width=13):
    """Words kept by each row: a null doc_id is greater than all others."""
    inf = float("inf")
    first, cut = {}, []
    for doc, text in rows:
        w = (text or "").encode().split()
        cut.append(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, inf), inf if doc is None else doc)
    out = []
    for (doc, _), w in zip(rows, cut, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (inf if doc is None else doc):
                gone |= set(range(i, i + width))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "a b", "x\ty"]
    passages = [" ".join(rng.choices(words, k=rng.randrange(10, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randrange(1, 40))))
            if rng.random() < 0.3:
                w = rng.choice(passages).split(" ")
                a = rng.randrange(len(w))
                parts.append("  ".join(w[a:]))
        rows.append((i, "\n".join(parts)))
    copy = rows[5][1]
    rows += [(n + i, copy) for i in range(40)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (None, passages[0]), (903, "z " * 5000), (904, "z " * 30), rows[3], rows[3], (3, passages[1] + " other " + passages[1]), (905, " ".join(passages[2].split())), (906, passages[3].upper())]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeats.deduplicate(df, bucket_bytes=10_000).collect()), key=repr)
    assert got == brute(rows)


def test_shuffled_joins_and_other_widths(spark):
    rows = corpus(9, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeats.deduplicate(df, width=9, block=4, most_broadcast=0).collect()), key=repr)
    assert got == brute(rows, 9)
    with pytest.raises(ValueError):
        repeats.deduplicate(df, width=9, block=6)


def test_empty_table(spark):
    assert repeats.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_first_hashes_are_told_apart_by_the_second():
    first, second = np.array([5, 5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    order, group = repeats._groups(first, second)
    assert [sorted(order[group == g].tolist()) for g in range(3)] == [[0, 2], [1, 4], [3]]
    raw, offs = K.buffers(pa.array(["one two three"]))
    s, e, _ = K.find_words(raw, offs, K.NOT_SPACE)
    a, b = K.hash_words(raw, s, e), K.hash_words(raw, s, e, second=True)
    assert not set(a) & set(b) and K.hash_windows(a, 2)[0] != K.hash_windows(a, 2, second=True)[0]
