"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame expressions only.

A paragraph (a non-empty piece between line feeds) hashes to a vector of 16 dense lanes of 32 bits, from two
SHA-256 digests under different prefixes; a text's dense lanes are the sum of its paragraphs' modulo 2^32. So equal multisets of
paragraphs have equal fingerprints in any order, and paragraphs can be added or taken away with ``combine``. 512 bits in such sums
keep unequal texts apart by chance alone; they do not withstand someone who builds texts to collide.

The lanes for likeness look into paragraphs: these are cut into pieces at ends of sentences, and at blanks where there is none, and a
piece adds one of two values to each of 120 lanes, by the bits of its digest. With the number of pieces a lane tells by how
many one value outweighs the other. Sums of products of these surpluses estimate the products of the two texts' piece counts, and
``likeness`` is their Tanimoto coefficient, whose error does not depend on the texts' lengths (a standard deviation of some 0.06 in the
middle, less towards 0 and 1). Three counters of 20 bits share a number, so likeness is told for up to 2^20 pieces; sums
of numbers are kept modulo 2^62 and stay additive beyond.

``sketch`` and ``jaccard`` estimate the multiset Jaccard of whole paragraphs. A paragraph
adds a Cauchy value to each lane of a sketch, so the lanes of two texts differ by
Cauchy values whose scale is the number of paragraphs by which the multisets
differ; with both counts that estimates the multiset Jaccard.

Defined results: null and empty texts, and texts of line feeds alone, have the
zero fingerprint; the likeness of two zero fingerprints is 1; repeated rows give
repeated results; very long texts are hashed piece by piece; the ids that order texts are cast to 64-bit numbers.
"""

from __future__ import annotations

from math import isqrt, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.cluster import table

DENSE, PACKED = 16, 40
CAUCHY, _CAUCHY_STEPS = 256, 1 << 24
_WIDTHS = [8] * (DENSE + 1) + [16] * PACKED
_THREE = 1 | 1 << 20 | 1 << 40
_PIECE = r"([^\n]{48,160}?(?:[.!?] |[。！？])|[^\n]{160}[^\n ]{0,96} ?|[^\n]+)"


def _masks() -> Column:
    return F.array(*(F.lit((1 << min(4 * w, 62)) - 1).cast("bigint") for w in _WIDTHS))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def _word(digest: Column, j: int | Column) -> Column:
    """The 32-bit number in the j-th eight digits."""
    at = j * 8 + 1
    return F.conv(F.substring(digest, at if isinstance(at, Column) else F.lit(at), F.lit(8)), 16, 10).cast("bigint")


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lanes(text: Column) -> Column:
    """The fingerprint as array<bigint>: dense lanes, the number of pieces, and how many of them have each bit set, three counts a number."""
    whole = F.coalesce(text, F.lit(""))
    zero = F.lit(0).cast("bigint")
    digests = F.transform(_split(whole), lambda p: F.concat(F.sha2(F.concat(F.lit("0:"), p), 256), F.sha2(F.concat(F.lit("1:"), p), 256)))
    # sums of 32-bit numbers do not reach 2^63 before 2^31 paragraphs
    dense = F.aggregate(digests, F.array_repeat(zero, DENSE), lambda acc, h: F.transform(acc, lambda x, j: x + _word(h, j)))
    pieces = _split(F.regexp_replace(whole, _PIECE, "$1\n"))

    def total(numbers: Column, k: int) -> Column:
        return F.aggregate(numbers, zero, lambda acc, v: (acc + F.shiftrightunsigned(v, k).bitwiseAND(_THREE)).bitwiseAND((1 << 62) - 1))

    def number(hs: Column, at: int) -> Column:
        return F.transform(hs, lambda h: F.conv(F.substring(h, F.lit(at), F.lit(15)), 16, 10).cast("bigint"))

    def counted(hs: Column) -> Column:
        parts = [_let(number(hs, at), lambda v: F.array(*(total(v, k) for k in range(PACKED // 2)))) for at in (1, 16)]
        return F.concat(F.array(F.size(hs).cast("bigint")), *parts)

    parts = _let(F.transform(pieces, lambda p: F.sha2(F.concat(F.lit("2:"), p), 256)), counted)
    return F.zip_with(F.concat(dense, parts), _masks(), lambda x, m: x.bitwiseAND(m))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the union of two multisets of paragraphs, or, with sign -1, of their difference."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + sign * y), _masks(), lambda x, m: x.bitwiseAND(m))


def spell(v: Column) -> Column:
    """Lanes as lower-case hex, eight digits a dense lane and the number of pieces, sixteen a number of counts."""
    wide = F.transform(F.slice(v, DENSE + 2, PACKED), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.concat(F.array_join(F.transform(F.slice(v, 1, DENSE + 1), lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.array_join(wide, "")))


def _surplus(v: Column) -> Column:
    """By how many pieces with a bit outnumber those without it, in each lane."""
    half, packed = 1 << 19, F.slice(v, DENSE + 2, PACKED)

    def lane(at: int) -> Column:
        return F.transform(packed, lambda x: (2 * F.shiftrightunsigned(x, at).bitwiseAND(2 * half - 1) - v[DENSE] + half).bitwiseAND(2 * half - 1) - half)

    return F.concat(*map(lane, (0, 20, 40)))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the Tanimoto coefficient of the texts' piece counts, estimated; 1 for equal fingerprints."""
    zero = F.lit(0).cast("bigint")
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), zero, lambda acc, p: acc + p)

    def ratio(t: Column) -> Column:
        both, other = t[0], t[1] + t[2] - t[0]
        return F.when(other == 0, F.lit(0.0)).otherwise(F.greatest(both, zero) / other)

    sums = _let(_surplus(a), lambda x: _let(_surplus(b), lambda y: F.array(total(x, y), total(x, x), total(y, y))))
    return F.when(a == b, F.lit(1.0)).otherwise(_let(sums, ratio))


def sketch(text: Column) -> Column:
    """The number of paragraphs, then for each lane the sum of the paragraphs' Cauchy values, in whole 1024ths, as array<bigint>."""
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")
    zero = F.array_repeat(F.lit(0).cast("bigint"), CAUCHY)

    def cauchy(p: Column, j: Column) -> Column:
        u = F.xxhash64(p, j).bitwiseAND(_CAUCHY_STEPS - 1)
        # for each of the steps what ``round`` gives, which goes by the decimal text of the number and takes most of the time
        return F.rint(F.tan((u + 0.5) * (pi / _CAUCHY_STEPS) - pi / 2) * 1024).cast("bigint")

    hashes = F.transform(paragraphs, lambda p: F.xxhash64(p))
    sums = F.aggregate(hashes, zero, lambda acc, h: F.transform(acc, lambda x, j: x + cauchy(h, j)))
    return F.concat(F.array(F.size(paragraphs).cast("bigint")), sums)


def combine_sketches(a: Column, b: Column, sign: int = 1) -> Column:
    """The sketch of the union of two multisets of paragraphs, or, with sign -1, of their difference."""
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def jaccard(a: Column, b: Column) -> Column:
    """The multiset Jaccard of the paragraphs of two sketches, from 0 to 1: estimated, but for equal sketches, which give 1."""
    gaps = F.sort_array(F.slice(F.zip_with(a, b, lambda x, y: F.abs(x - y)), 2, CAUCHY))
    both = a[0] + b[0]

    def common(g: Column) -> Column:
        differ = (g[CAUCHY // 2 - 1] + g[CAUCHY // 2]) / 2048
        return F.greatest(F.least(F.round((both - differ) / 2), a[0], b[0]), F.lit(0.0))

    # the gaps are sorted once
    return F.when(a == b, F.lit(1.0)).otherwise(_let(_let(gaps, common), lambda c: c / (both - c)))


def fingerprints(docs: DataFrame, *, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the spelt fingerprint of each text in column ``out`` (replaced if there)."""
    return docs.withColumn(out, spell(lanes(F.col(text))))


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", range_bytes: int = 64 << 20, carry=None) -> DataFrame:
    """doc_id, text and next_text: the text of the next lower doc_id, for the last row that of the first.

    Rows are dealt by ranges of doc_id of about ``range_bytes`` of text (at least twice as many as the session's shuffle
    partitions), between approximate quantiles. Each range also gets a copy of the first row of the range below, so one shuffle
    of the texts does. Null doc_ids come last; rows of one doc_id are in the order of their texts. ``carry``, a function of the text
    column, is computed once a row, and adds carried and next_carried.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    cuts = base.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    step = max(1, isqrt(len(cuts)))
    if cuts:
        # two looks at about sqrt(n) cuts each
        heads, every = F.array(*map(F.lit, cuts[::step])), F.array(*map(F.lit, cuts))
        coarse = F.size(F.filter(heads, lambda c: c >= key))
        fine = F.size(F.filter(F.slice(every, F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step)), lambda c: c >= key))
        bucket = F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)
    else:
        bucket = F.lit(0)
    dealt = base.withColumns({"key": key, "bucket": bucket.cast("int"), "copy": F.lit(False)})
    firsts = sorted((r["bucket"], r["key"]) for r in dealt.groupBy("bucket").agg(F.max("key").alias("key")).collect())
    above = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    copies = spark.createDataFrame([(k, above[b]) for b, k in firsts], "key bigint, to int")
    copies = dealt.drop("bucket").join(F.broadcast(copies), "key").select("doc_id", "text", "key", F.col("to").alias("bucket"), F.lit(True).alias("copy"))
    order = Window.partitionBy("bucket").orderBy("copy", F.desc("key"), "text")
    rows = dealt.unionByName(copies).withColumn("next_text", F.lead("text").over(order))
    if carry is not None:
        # the same window again, so without another shuffle
        rows = rows.withColumn("carried", carry(F.col("text"))).withColumn("next_carried", F.lead("carried").over(order))
    return rows.filter("not copy").select("doc_id", "text", "next_text", *(["carried", "next_carried"] if carry is not None else []))


def _edited(spark, sf_dir: str, carry) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"), carry=carry)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(next_text, 1, length(text) div 2)"))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("carried").alias("text"), F.col("next_carried").alias("next_text"))


def op9(spark, sf_dir: str) -> DataFrame:
    rows = _edited(spark, sf_dir, lanes)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), lanes(F.col("edited")).alias("edited"), "text", "next_text")
    return rows.select("doc_id", "n_chars", "edited_sha256", spell(F.col("text")).alias("fingerprint"), spell(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("next_text")).alias("near_next"))


def paragraph_likeness(spark, sf_dir: str) -> DataFrame:
    """op9's pairs of texts, with the likeness that holds at any length."""
    rows = _edited(spark, sf_dir, sketch)
    rows = rows.select("doc_id", "n_chars", sketch(F.col("edited")).alias("edited"), "text", "next_text")
    return rows.select("doc_id", "n_chars", F.col("text")[0].alias("paragraphs"), jaccard(F.col("text"), F.col("edited")).alias("near_edited"), jaccard(F.col("text"), F.col("next_text")).alias("near_next"))


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pairs AS (
    SELECT doc_id, t, coalesce(lead(t) OVER o, first_value(t) OVER (ORDER BY doc_id DESC)) AS nx
    FROM docs WINDOW o AS (ORDER BY doc_id DESC)),
texts AS (
    SELECT doc_id, length(t) AS n, t, nx, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) AS ed FROM pairs),
bodies AS (SELECT doc_id, 't' AS kind, t AS body FROM texts UNION ALL SELECT doc_id, 'e', ed FROM texts UNION ALL SELECT doc_id, 'n', nx FROM texts),
paragraphs AS (SELECT doc_id, kind, sha256('0:' || p) || sha256('1:' || p) AS h FROM bodies, unnest(string_split(body, chr(10))) AS u(p) WHERE p <> ''),
dense AS (
    SELECT doc_id, kind, j, sum(CAST('0x' || substr(h, 8 * j + 1, 8) AS BIGINT)) % 4294967296 AS v
    FROM paragraphs, range(0, {DENSE}) AS r(j) GROUP BY doc_id, kind, j),
pieces AS (
    SELECT doc_id, kind, sha256('2:' || p) AS h FROM bodies, unnest(string_split(regexp_replace(body, '{_PIECE}', '\\1' || chr(10), 'g'), chr(10))) AS u(p) WHERE p <> ''),
numbers AS (SELECT doc_id, kind, w, CAST('0x' || substr(h, 15 * w + 1, 15) AS BIGINT) AS v FROM pieces, range(0, 2) AS r(w)),
n_pieces AS (SELECT doc_id, kind, count(*) AS n FROM pieces GROUP BY ALL),
packed AS (SELECT doc_id, kind, {PACKED // 2} * w + k AS j, CAST(sum((v >> k) & {_THREE}) % {1 << 62} AS BIGINT) AS v FROM numbers, range(0, {PACKED // 2}) AS r(k) GROUP BY doc_id, kind, w, k),
ones AS (SELECT doc_id, kind, 3 * j + i AS j, (v >> (20 * i)) & 1048575 AS v FROM packed, range(0, 3) AS r(i)),
spelt AS (
    SELECT doc_id, kind, string_agg(s, '' ORDER BY part, j) AS fp
    FROM (SELECT doc_id, kind, 0 AS part, j, printf('%08x', CAST(v AS BIGINT)) AS s FROM dense UNION ALL SELECT doc_id, kind, 1, 0, printf('%08x', n) FROM n_pieces
          UNION ALL SELECT doc_id, kind, 2, j, printf('%016x', v) FROM packed) AS b GROUP BY doc_id, kind),
named AS (
    SELECT doc_id, coalesce(max(CASE WHEN kind = 't' THEN fp END), repeat('0', {sum(_WIDTHS)})) AS ft,
           coalesce(max(CASE WHEN kind = 'e' THEN fp END), repeat('0', {sum(_WIDTHS)})) AS fe,
           coalesce(max(CASE WHEN kind = 'n' THEN fp END), repeat('0', {sum(_WIDTHS)})) AS fn
    FROM texts LEFT JOIN spelt USING (doc_id) GROUP BY doc_id),
surplus AS (SELECT doc_id, kind, j, CAST(2 * v - n AS BIGINT) AS x FROM ones JOIN n_pieces USING (doc_id, kind)),
sums AS (
    SELECT doc_id, coalesce(sum(a * a), 0) AS aa, coalesce(sum(b * b), 0) AS bb, coalesce(sum(c * c), 0) AS cc, coalesce(sum(a * b), 0) AS ab, coalesce(sum(a * c), 0) AS ac
    FROM (SELECT doc_id, j, coalesce(max(CASE WHEN kind = 't' THEN x END), 0) AS a, coalesce(max(CASE WHEN kind = 'e' THEN x END), 0) AS b, coalesce(max(CASE WHEN kind = 'n' THEN x END), 0) AS c FROM surplus GROUP BY doc_id, j)
    GROUP BY doc_id)
SELECT doc_id, n AS n_chars, sha256(ed) AS edited_sha256, ft AS fingerprint, fe AS edited_fingerprint,
       CASE WHEN ft = fe THEN CAST(1 AS DOUBLE) WHEN coalesce(aa + bb - ab, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(greatest(ab, 0) AS DOUBLE) / CAST(aa + bb - ab AS DOUBLE) END AS near_edited,
       CASE WHEN ft = fn THEN CAST(1 AS DOUBLE) WHEN coalesce(aa + cc - ac, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(greatest(ac, 0) AS DOUBLE) / CAST(aa + cc - ac AS DOUBLE) END AS near_next
FROM texts JOIN named USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
