import zlib
from collections import Counter

import pytest

from timberline.llm import shard


def rows(n, hot=0):
    out = [(i, f"text {i} " * (i % 37 + 1), f"src{i % 5}" if i % 11 else None, "en" if i % 3 else "fr") for i in range(n)]
    return out + [(n + i, "the same text " * 20, f"src{i % 5}", "de") for i in range(hot)]


@pytest.mark.parametrize(("hot", "leaves"), [(0, 8), (5, 8), (900, 8), (50, 5)])
def test_shards_are_near_equal_and_numbered_without_gaps(spark, hot, leaves):
    data = [*rows(1800, hot), (None, None, None, None), (7, None, None, "en"), (5000, "x" * 2000, "s", "en"), (5000, "x" * 2000, "s", "en")]
    got = shard.shards(spark.createDataFrame(data, "doc_id long, text string, source string, lang string").repartition(3), leaves=leaves).collect()
    assert len(got) == len(data) and Counter(r.doc_id for r in got) == Counter(r[0] for r in data)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert set(sizes) == set(range(leaves))
    assert max(sizes.values()) - min(sizes.values()) <= 0.1 * sum(sizes.values()) / leaves
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    texts = {d[0]: d[1] or "" for d in data}
    for r in got[:50]:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    if 0 < hot <= 20:
        assert len({r.shard for r in got if (r.doc_id or 0) in range(1800, 1800 + hot)}) == 1


def test_target_bytes_and_empty_table(spark):
    kind = "doc_id long, text string, source string, lang string"
    df = spark.createDataFrame(rows(300), kind)
    total = sum(len(r[1].encode()) + 1 for r in rows(300))
    assert shard.shards(df, target_bytes=total // 3).agg({"shard": "max"}).first()[0] in (2, 3)
    assert shard.shards(spark.createDataFrame([], kind), leaves=8).count() == 0


def test_all_rows_alike(spark):
    df = spark.createDataFrame([(i, "same", "s", "en") for i in range(800)], "doc_id long, text string, source string, lang string")
    counts = Counter(r.shard for r in shard.shards(df, leaves=8).collect())
    assert len(counts) == 8 and max(counts.values()) <= 110


def test_heavy_equal_texts_stay_whole_and_sizes_near_equal(spark):
    data = rows(1800)
    leaf = sum(len(r[1].encode()) + 1 for r in data) // 8
    for g, share in enumerate((0.3, 0.3, 0.45, 0.2)):
        data += [(2000 + 10 * g + i, f"{g}" * (int(leaf * share) // 2), f"src{i}", "en") for i in range(2)]
    got = shard.shards(spark.createDataFrame(data, "doc_id long, text string, source string, lang string").repartition(3), leaves=8).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert len(got) == len(data) and max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8
    for g in range(4):
        assert len({r.shard for r in got if 2000 + 10 * g <= (r.doc_id or 0) < 2010 + 10 * g}) == 1


def test_only_heavy_groups(spark):
    data = [(10 * g + i, f"text {g} " * 50, "s", "en") for g in range(8) for i in range(3)]
    got = shard.shards(spark.createDataFrame(data, "doc_id long, text string, source string, lang string"), leaves=8).collect()
    assert len(got) == 24 and len({r.shard for r in got}) == 8 and all(len({r.shard for r in got if r.doc_id // 10 == g}) == 1 for g in range(8))
