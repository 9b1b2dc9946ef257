import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from timberline.llm import jaccard


def grams(text, n=5):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    if 0 < len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(rows):
    sets = [grams(t) for _, t in rows]
    n, near = len(rows), [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                near[i].add(j)
                near[j].add(i)
    out, seen = {}, {}
    for i in range(n):
        if i in seen:
            continue
        stack, comp = [i], {i}
        while stack:
            for j in near[stack.pop()] - comp:
                comp.add(j)
                stack.append(j)
        ids = [rows[j][0] for j in comp if rows[j][0] is not None]
        for j in comp:
            seen[j] = min(ids) if ids else None
    for i in range(n):
        same = [k for k in range(n) if sets[k] == sets[i] and sets[i]] or [i]
        ids = [rows[k][0] for k in same if rows[k][0] is not None]
        out[i] = (rows[i][0], seen[i], min(ids) if ids else None, len(same), len(near[i]))
    return Counter(out.values())


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randrange(1, 150))
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    base = rng.choices(words, k=120)
    for _ in range(60):  # one dense group of near copies, larger than a block below
        w = list(base)
        w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((len(rows), ", ".join(w).upper()))
    rows += [(len(rows) + i, " ".join(base)) for i in range(30)]
    rows += [(5000, None), (5001, ""), (5002, "..."), (5003, "one two"), (5004, "One, two!"), (None, "one two"), (None, rows[3][1]), rows[4], rows[4], (5005, "x " * 60_000), (5006, "x " * 50)]
    return rows


@pytest.mark.parametrize(("seed", "most"), [(1, 500_000), (2, 0)])
def test_equals_brute_force(spark, seed, most):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
    got = jaccard.join(df, block_nodes=16, most_broadcast=most).collect()
    assert Counter((r.doc_id, r.class_id, r.copy_id, r.n_copies, r.n_links) for r in got) == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in jaccard.keep_one(df).collect()]
    want = {c for _, c, *_ in brute(rows)} - {None}
    assert {k for k in kept if k is not None} == want and Counter(kept)[rows[4][0]] == (1 if rows[4][0] in want else 0)
    assert None not in kept
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_nameless_and_shared_ids_leave_one_row_a_class(spark):
    rng = random.Random(7)
    base = [f"v{rng.randrange(900)}" for _ in range(80)]
    near = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(6)]
    rows = [(None, t, 1) for t in near] + [(None, "alone here", 1), (None, "alone here", 2), (None, None, 1), (None, None, 2), (9, "other words " + near[0][::-1], 1), (9, "other words " + near[0][::-1] + " x", 1)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, __n int")).collect()
    assert len([r for r in kept if r.text in near]) == 1 and len([r for r in kept if r.text == "alone here"]) == 1
    assert len([r for r in kept if r.text is None]) == 1 and len([r for r in kept if r.doc_id == 9]) == 1 and len(kept) == 4


def test_chained_buckets_meet_only_where_they_share_a_band(spark):
    """A long chain of texts, each near the next: one component of many blocks, links between neighbours alone."""
    words = [f"c{i}" for i in range(4000)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 120])) for k in range(400)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_nodes=8, threshold=0.8).collect()
    assert Counter((r.doc_id, r.class_id, r.copy_id, r.n_copies, r.n_links) for r in got) == brute(rows)


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = jaccard.choose_bands(threshold, 0.999, 400)
        assert bands * rows <= 400 and (1 - threshold**rows) ** bands <= 0.001
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.1, 0.999, 50)


def test_links_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(40)]
    got = jaccard.links(sets, sets, Fraction("0.8"))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (5 * len(x & y) >= 4 * len(x | y))
