"""N-gram Jaccard join: MinHash bands for candidates, full n-gram sets for the links.

1. A text's set holds the 64-bit hashes of its runs of ``n`` words (digits, a-z after
   lower-casing A-Z, bytes beyond ASCII); a text of fewer words has one shorter run.
   Texts with equal sets are one node (a 128-bit digest), so copies cost one row.
2. A node's MinHash signature is cut into bands of rows; ``choose_bands`` takes the most
   rows a band whose bands, within ``max_hashes``, still reach the target recall at the
   threshold. Band hashes are shuffled; those of two nodes or more link each to the least.
3. Connected nodes make a candidate component, whose nodes are dealt to blocks of about ``block_nodes`` nodes
   and ``block_grams`` n-grams, those of one large bucket together. Only pairs of blocks that share a band
   hash meet, spread over tasks: each counts the common n-grams of all its pairs by matrix products and gives
   each node's number of links and a spanning forest of them. So a chain of buckets costs as much as its
   buckets do, no pair that shares a band is left out, and none is emitted.
4. Components of the links are the classes.

Recall is the bands'; what they bring together is decided exactly.

Defined results: null texts and texts without words have no links and are classes by
themselves; a class is named by its least doc_id (null only if all are); repeated rows
are copies of each other; an empty table gives no rows; only the two named columns
are read. Ids are cast to 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm import kernels as K
from timberline.llm.cluster import BROADCAST_BYTES, broadcast_if, lean, materialize
from timberline.llm.components import components, contract

_U = np.uint64


def choose_bands(threshold: float, recall: float = 0.9999, max_hashes: int = 192) -> tuple[int, int]:
    """(bands, rows a band): the most rows for which so many hashes reach the recall at the threshold."""
    best = None
    for rows in range(1, max_hashes + 1):
        miss, bands = 1.0, 0
        while miss > 1 - recall and (bands + 1) * rows <= max_hashes:
            bands += 1
            miss *= 1 - threshold**rows
        if miss <= 1 - recall:
            best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def gram_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-gram hashes, ascending, and their places (rows + 1)."""
    low = K.LOWER[buf]
    s, e, at = K.find_words(low, offs, K.ALNUM)
    words = K.hash_words(low, s, e)
    h = K.hash_windows(words, n)
    ok = np.flatnonzero(K.inside(at, n)) if len(h) else np.zeros(0, np.int64)
    row = np.searchsorted(at, ok, side="right") - 1
    h = h[ok]
    sizes = np.diff(at)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    h = np.concatenate([h, np.array([K.hash_windows(words[at[r] : at[r + 1]], int(sizes[r]))[0] for r in short], dtype=_U)])
    row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(offs)))


def _node(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _sketch(n: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20_240_101)
        mult = rng.integers(0, 1 << 63, bands * rows, dtype=_U) * _U(2) + _U(1)
        add = rng.integers(0, 1 << 63, bands * rows, dtype=_U)
        for batch in batches:
            raw, offs = K.buffers(batch.column("text"))
            for lo, hi in K.row_slices(offs):
                h, at = gram_sets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n)
                full = np.flatnonzero(np.diff(at))
                keys = np.zeros((len(full), bands), dtype=_U)
                if len(full):
                    for b in range(bands):
                        key = np.full(len(full), b + 1, dtype=_U)
                        for k in range(b * rows, (b + 1) * rows):
                            key = key * _U(0x9E3779B97F4A7C15) + K.mix(np.minimum.reduceat(h * mult[k] + add[k], at[full]))
                        keys[:, b] = K.mix(key)
                nodes: list[bytes | None] = [None] * (hi - lo)
                signatures: list[list[int] | None] = [None] * (hi - lo)
                for i, r in enumerate(full):
                    nodes[r] = _node(h[at[r] : at[r + 1]])
                    signatures[r] = keys[i].view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "mark")), pa.array(nodes, pa.binary()), pa.array(np.diff(at)), pa.array(signatures, pa.list_(pa.int64()))], names=["doc_id", "mark", "node", "n_grams", "bands"])

    return sketch


def _sets(n: int):
    """The sets of candidate nodes; rows of the same doc_id but another set fall out."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = K.buffers(batch.column("text"))
            nodes = batch.column("node").to_pylist()
            for lo, hi in K.row_slices(offs):
                h, at = gram_sets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n)
                mine = [i for i in range(hi - lo) if at[i + 1] > at[i] and _node(h[at[i] : at[i + 1]]) == nodes[lo + i]]
                part = batch.slice(lo, hi - lo).take(pa.array(mine, pa.int64()))
                cols = [part.column(c) for c in ("label", "block", "id", "copies")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([h[at[i] : at[i + 1]].tobytes() for i in mine], pa.binary())], names=["label", "block", "id", "copies", "grams"])

    return sets


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of common n-grams of every set of a with every set of b, exactly."""
    ha, hb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ha, hb)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    if not len(both):
        return out
    ra = np.repeat(np.arange(len(a)), [len(x) for x in a])
    rb = np.repeat(np.arange(len(b)), [len(x) for x in b])
    ca, cb = (np.minimum(np.searchsorted(both, h), len(both) - 1) for h in (ha, hb))
    ka, kb = both[ca] == ha, both[cb] == hb
    ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    step = 8192
    for lo in range(0, len(both), step):
        ma, mb = np.zeros((len(a), step), np.float32), np.zeros((len(b), step), np.float32)
        for m, r, c in ((ma, ra, ca), (mb, rb, cb)):
            i, j = np.searchsorted(c, [lo, lo + step])
            m[r[i:j], c[i:j] - lo] = 1
        out += ma @ mb.T
    return out


def links(a: list[np.ndarray], b: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least the threshold."""
    both = _common(a, b).astype(np.int64)
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    return both * (threshold.numerator + threshold.denominator) >= threshold.numerator * sizes


def _forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric link matrix the least index each index is connected with."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(threshold: Fraction):
    """Rows (u, v, n): with v null, u has n more links; else u and v are connected."""

    def decide(group: list[tuple]) -> tuple[list, list, list]:
        members: dict[int, dict[int, tuple]] = {}
        for _, i, j, block, name, copies, grams in group:
            members.setdefault(block, {})[name] = (copies, np.frombuffer(grams, _U))
        i, j = group[0][1], group[0][2]
        if i not in members or j not in members:
            return [], [], []
        left, right = members[i], members[j]
        a, b = list(left), list(right)
        m = links([left[x][1] for x in a], [right[x][1] for x in b], threshold)
        if i == j:
            np.fill_diagonal(m, False)
        u, v, n = [], [], []

        def tell(names: list[int], counts: np.ndarray) -> None:
            for k in np.flatnonzero(counts):
                u.append(names[k])
                v.append(None)
                n.append(int(counts[k]))

        tell(a, m @ np.array([right[x][0] for x in b], dtype=np.int64))
        if i != j:
            tell(b, m.T @ np.array([left[x][0] for x in a], dtype=np.int64))
            full = np.zeros((len(a) + len(b),) * 2, dtype=bool)
            full[: len(a), len(a) :] = m
            full[len(a) :, : len(a)] = m.T
            names = a + b
        else:
            full, names = m, a
        root = _forest(full)
        for k in np.flatnonzero(root != np.arange(len(root))):
            u.append(names[k])
            v.append(names[root[k]])
            n.append(0)
        return u, v, n

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], ([], [], [])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["u", "v", "n"])

        for got in batches:
            for row in zip(*(c.to_pylist() for c in got.columns), strict=True):
                if row[:3] != now:
                    if group:
                        for to, x in zip(out, decide(group), strict=True):
                            to += x
                    now, group = row[:3], []
                    if len(out[0]) > 10_000:
                        yield batch()
                        out = ([], [], [])
                group.append(row)
        if group:
            for to, x in zip(out, decide(group), strict=True):
                to += x
        if out[0]:
            yield batch()

    return verify


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, class_id (least doc_id of the connected class), copy_id (least doc_id of an equal set),
    n_copies (rows of that set) and n_links (other rows at the threshold or above) of each row; ``options`` are those of ``classes``."""
    sketch, last = classes(docs, doc_id=doc_id, text=text, **options)
    return sketch.select("doc_id", "node").join(last, "node", "left").select(
        "doc_id",
        F.coalesce("class_id", "copy_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("copies", F.lit(1).cast("bigint")).alias("n_copies"),
        (F.coalesce("others", F.lit(0).cast("bigint")) + F.coalesce("copies", F.lit(1).cast("bigint")) - 1).alias("n_links"),
    )


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, max_hashes: int = 192, block_nodes: int = 128, block_grams: int = 1 << 19, most_broadcast: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, mark (digest of its text) and node; and of each node that has copies or links: copy_id, copies, others (links
    to other nodes' rows), class_no and class_id."""
    bands, rows = choose_bands(threshold, recall, max_hashes)
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketch = materialize(base.withColumn("mark", F.unhex(F.md5("text"))).mapInArrow(lean(_sketch(n, bands, rows)), "doc_id bigint, mark binary, node binary, n_grams bigint, bands array<bigint>"), "sketch")
    nodes = sketch.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    # numbers stand for nodes from here on: fixed once they are written
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")

    # candidates: nodes that share a band hash
    keys = nodes.select("id", F.explode("bands").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("most"), F.count("*").alias("held")).filter("hub <> most").drop("most"), "bands")
    seats = keys.join(broadcast_if(shared, most_broadcast), "key")
    # a node has at most as many hubs as bands: it keeps the least, which takes over the others
    stars = materialize(seats.filter("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct(), "hubs")
    held = components(contract(stars, most_broadcast), most_broadcast)
    member = materialize(nodes.drop("bands").join(broadcast_if(held.withColumnRenamed("node", "id"), most_broadcast), "id").select("label", "id", "node", "copy_id", "copies", "n_grams"), "members")

    # blocks of components that are too large for one: a bucket's nodes together, unless they are too many themselves
    size = F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n_grams") / block_grams)).cast("int")
    large = materialize(member.groupBy("label").agg(size.alias("blocks")).filter("blocks > 1"), "large")
    within = broadcast_if(materialize(member.join(broadcast_if(large, most_broadcast), "label").select("label", "id", "blocks"), "within"), most_broadcast)
    seats = materialize(seats.select("id", "key", "held").join(within, "id"), "seats")
    home = seats.groupBy("label", "id", "blocks").agg(F.max(F.struct("held", "key")).alias("home"))
    chunk = F.pmod(F.xxhash64("id"), F.ceil(4 * F.col("home.held") / block_nodes).cast("bigint"))
    dealt = materialize(home.select("label", "id", F.pmod(F.xxhash64("home.key", chunk), F.col("blocks")).cast("int").alias("block")), "dealt")
    met = seats.select("id", "key").join(broadcast_if(dealt, most_broadcast), "id").groupBy("label", "key").agg(F.sort_array(F.collect_set("block")).alias("met")).select("label", "met").distinct()
    met = met.select("label", "met", F.explode("met").alias("i")).select("label", "i", F.explode(F.filter("met", lambda x: x >= F.col("i"))).alias("j")).distinct()
    met = materialize(met.select("label", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), "meetings")

    # the sets of two blocks meet
    wanted = materialize(member.join(broadcast_if(dealt.select("id", "block"), most_broadcast), "id", "left").withColumn("block", F.coalesce("block", F.lit(0))), "candidates")
    grams = _fetch(base, wanted, most_broadcast).mapInArrow(lean(_sets(n)), "label bigint, block int, id bigint, copies bigint, grams binary")
    pairs = grams.join(broadcast_if(met, most_broadcast), ["label", "block"], "left").select("label", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("j", F.lit(0)).alias("j"), "block", "id", "copies", "grams")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(pairs.repartition(parts, "label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(lean(_verify(Fraction(str(threshold)))), "u bigint, v bigint, n bigint"), "links")

    counts = materialize(found.filter("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("others")), "counts")
    joined = components(contract(found.filter("v is not null").select("u", "v"), most_broadcast), most_broadcast).select(F.col("node").alias("id"), "label")
    placed = materialize(member.select("id", "copy_id").join(broadcast_if(joined, most_broadcast), "id"), "placed")
    least = materialize(placed.groupBy("label").agg(F.min("copy_id").alias("class_id")), "least")
    linked = materialize(placed.select("id", "label").join(broadcast_if(least, most_broadcast), "label").select("id", F.col("label").alias("class_no"), "class_id"), "linked")
    special = nodes.select("id", "node", "copy_id", "copies").join(broadcast_if(counts, most_broadcast), "id", "left").join(broadcast_if(linked, most_broadcast), "id", "left").filter("copies > 1 or others is not null")
    return sketch, broadcast_if(materialize(special.withColumn("class_no", F.coalesce("class_no", "id")).drop("id"), "classes"), most_broadcast)


def _fetch(base: DataFrame, wanted: DataFrame, most_broadcast: int) -> DataFrame:
    """Texts of the candidates' first rows; several rows may have that doc_id."""
    names = broadcast_if(wanted.select("copy_id", "label", "block", "id", "node", "copies"), most_broadcast)
    return base.join(names, base["doc_id"].eqNullSafe(names["copy_id"])).select("label", "block", "id", "node", "copies", "text")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most_broadcast: int = BROADCAST_BYTES, **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id (null ones come last), then of the least text digest.
    Of other rows that share doc_id and text one stays, too."""
    sketch, last = classes(docs, doc_id=doc_id, text=text, most_broadcast=most_broadcast, **options)
    rows = materialize(sketch.select("doc_id", "mark", "node").join(last.select("node", "class_no"), "node").select("doc_id", "mark", "class_no"), "class-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark"))
    stay = materialize(rows.groupBy("class_no").agg(first.alias("stay")).select("class_no", "stay.*").drop("nameless"), "stay")
    kept = broadcast_if(stay.select("class_no", F.col("doc_id").alias("__id"), F.col("mark").alias("__m")), most_broadcast)
    gone = materialize(rows.join(kept, "class_no").filter(~(F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("mark").eqNullSafe(F.col("__m")))).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__m")).distinct(), "gone")
    here = lambda t: F.col("here").eqNullSafe(t["__id"]) & F.col("mark").eqNullSafe(t["__m"])
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.col(doc_id).cast("bigint").alias("here"), F.unhex(F.md5(text)).alias("mark"))
    gone = broadcast_if(gone, most_broadcast)
    left = whole.join(gone, here(gone), "left_anti")
    twice = materialize(sketch.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__m")).agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    if twice.isEmpty():
        return left.select("whole.*")
    twice = broadcast_if(twice, most_broadcast)
    left = left.join(twice, here(twice), "left").select("whole", "here", "mark", "n")
    nth = F.row_number().over(Window.partitionBy("here", "mark").orderBy(F.lit(0)))
    again = left.filter("n is not null").withColumn("nth", nth).filter("nth = 1")
    return left.filter("n is null").select("whole.*").union(again.select("whole.*"))
