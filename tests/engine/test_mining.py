import random

import pytest
from pyspark.sql import functions as F

from timberline.functions import fnv
from timberline.operators import mining


def simulate(rows, depth=4, threshold=0.5):
    """The sequential miner over all buckets of a stream, ids in order of creation."""
    out, templates = {}, {}
    for stream, offset, tokens in sorted(rows, key=lambda r: (r[0], r[1])):
        mine = templates.setdefault(stream, [])
        best, most = None, -1.0
        for t in mine:
            if len(t[0]) != len(tokens) or t[0][:depth] != tokens[:depth] and any(a != b for a, b in zip(t[3][:depth], tokens[:depth], strict=True)):
                continue
            if t[3][:depth] != tokens[:depth]:
                continue
            same = sum(a == b or b == "<*>" for a, b in zip(tokens, t[0], strict=True)) / len(tokens)
            if same >= threshold and same > most:
                best, most = t, same
        if best is None:
            best = [list(tokens), 1, 1, list(tokens), len(mine)]
            mine.append(best)
        else:
            wide = [a if a == b or j < depth else "<*>" for j, (a, b) in enumerate(zip(best[0], tokens, strict=True))]
            best[1] += wide != best[0]
            best[0] = wide
            best[2] += 1
        out[stream, offset] = (best[4], " ".join(best[0]), best[1], best[2])
    return out


def rows_of(seed, n=700):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([1, 3, 5, 6, 8, 9, 12, 14])
        tokens = [rng.choice("AB") for _ in range(min(size, 4))] + [rng.choice("xyzuvw") for _ in range(size - 4)]
        rows.append((rng.choice(["s1", "s2"]), i * 3, tokens))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "depth", "threshold"), [(1, 4, 0.5), (2, 5, 0.5), (3, 3, 0.7), (4, 1, 0.4)])
def test_equals_the_sequential_miner_under_any_partitioning(spark, seed, depth, threshold):
    rows = rows_of(seed)
    want = simulate(rows, depth, threshold)
    for parts in (2, 9):
        df = spark.createDataFrame(rows, "stream_id string, source_offset long, masked array<string>").repartition(parts)
        got = {(r.stream_id, r.source_offset): (r.template_id, r.pattern, r.version, r.seen) for r in mining.mine_online(df, mining.Params(depth, threshold)).collect()}
        assert got == want


def mined(spark, lines, **params):
    rows = [("s", i, t.split(" ") if t else []) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "stream_id string, source_offset long, masked array<string>")
    return mining.mine_online(df, mining.Params(**params))


def test_widening_ties_and_prefix(spark):
    got = {r.source_offset: r for r in mined(spark, ["A B C D foo", "A B C D bar", "A B C D bar", "X B C D foo", ""]).collect()}
    assert [got[i].pattern for i in range(5)] == ["A B C D foo", "A B C D <*>", "A B C D <*>", "X B C D foo", None]
    assert [got[i].version for i in range(4)] == [1, 2, 2, 1] and [got[i].template_id for i in range(5)] == [0, 0, 0, 1, None]
    # equal similarity goes to the older template
    ties = mined(spark, ["p a a a", "p b b b", "p a b c"], depth=1, threshold=0.5).orderBy("source_offset").collect()
    assert [r.template_id for r in ties] == [0, 1, 0]


def test_registry_states_eviction_and_lifecycle(spark):
    m = mined(spark, ["a b"] * 5 + ["c d"] * 4 + ["e f"])
    t = mining.registry(m)
    assert sorted((r.pattern, r.occurrence_count, r.first_seen, r.last_seen, r.state) for r in t.collect()) == [("a b", 5, 0, 4, "stable"), ("c d", 4, 5, 8, "emerging"), ("e f", 1, 9, 9, "emerging")]
    assert {r.pattern: r.state for r in mining.registry(m, mining.Params(stable_at=1)).collect()}["e f"] == "emerging"
    assert {r.pattern: r.state for r in mining.evict(t, 1).collect()} == {"a b": "stable", "c d": "cold", "e f": "cold"}
    life = {r.pattern: r.state for r in mining.lifecycle(t, m, now=10, retention=5, recent=3).collect()}
    assert life == {"a b": "retired", "c d": "emerging", "e f": "emerging"}


def test_fingerprints_merge_and_split(spark):
    m = mined(spark, ["k 1 x"] * 6 + ["k 2 x"] * 3 + ["w q q q " + v for v in ("up", "down") * 6]).withColumn("fingerprint", fnv.fingerprint(F.col("masked")))
    t = mining.registry(m)
    merge = mining.merge_candidates(t).collect()
    assert [(r.template_id, r.survivor, r.position, r.version) for r in merge] == [(1, 0, 1, 2)]
    split = mining.split_candidates(m, t).collect()
    assert [(r.template_id, r.position, r.n_values, r.constants) for r in split] == [(2, 4, 2, "down|up")]
    resolved = {r.pattern for r in mining.resolve_fingerprints(m, t).collect()}
    assert resolved == {"k 1 x", "k 2 x", "w q q q <*>"}


def test_similarity(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "<*>"]), (["a"], ["a", "b"]), ([], []), (["a", "b"], ["a", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(mining.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0, 0.5]
