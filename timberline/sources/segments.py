"""Sealed segments: Parquet folders by segment and a manifest of versions.

A segment's rows never change. The manifest is rewritten as a new version whenever
segments are sealed, compacted, evicted or quarantined, and the highest version
counts; so a reader sees one consistent set. A writer claims the next version by creating a file that must not
be there; of two writers one waits and starts from what the other wrote.

Postings (term, segment) are written with each segment that has tokens, before the manifest names it. A segment without postings is
a candidate for every term, so searching by terms never loses an event.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import running

MANIFEST = "segment_id bigint, stream_id string, first_offset bigint, last_offset bigint, first_time timestamp, last_time timestamp, n bigint, checksum bigint, state string, schema_version int"
SCHEMA_VERSION = 1


def checksum(columns: list[str]) -> Column:
    """The same for the same rows in any order."""
    return F.bit_xor(F.xxhash64(*columns))


class Store:
    """Segments under one path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> set[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()

    def _done(self, folder: str) -> bool:
        fs, p = self._fs(f"{self.path}/{folder}/_SUCCESS")
        return fs.exists(p)

    def _version(self) -> int:
        told = sorted((int(n[1:]) for n in self._names("manifest") if n.startswith("v")), reverse=True)
        return next((v for v in told if self._done(f"manifest/v{v}")), 0)

    def manifest(self) -> DataFrame:
        """One row a segment and stream."""
        v = self._version()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{v}") if v else self.spark.createDataFrame([], MANIFEST)

    def _swap(self, change: Callable[[DataFrame], DataFrame], patience: float = 60.0) -> None:
        """The manifest becomes what ``change`` makes of it; it is called again if another writer came first."""
        until = time.monotonic() + patience
        while True:
            v = self._version()
            fs, claim = self._fs(f"{self.path}/claims/v{v + 1}")
            fs.mkdirs(claim.getParent())
            if fs.createNewFile(claim):
                try:
                    change(self.manifest()).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{v + 1}")
                except Exception:
                    fs.delete(claim, False)
                    raise
                return
            if time.monotonic() > until:
                raise TimeoutError(f"another writer holds version {v + 1}; if it is gone, delete {claim}")
            time.sleep(0.2)

    def _folder(self, segment: int) -> str:
        return f"{self.path}/data/segment_id={segment}"

    def _row(self, segment: int, rows: DataFrame) -> DataFrame:
        columns = sorted(rows.columns)
        return rows.groupBy("stream_id").agg(F.min("source_offset").alias("first_offset"), F.max("source_offset").alias("last_offset"), F.min("time").cast("timestamp").alias("first_time"), F.max("time").cast("timestamp").alias("last_time"), F.count("*").alias("n"), checksum(columns).alias("checksum")).select(
            F.lit(segment).cast("bigint").alias("segment_id"), "stream_id", "first_offset", "last_offset", "first_time", "last_time", "n", "checksum", F.lit("sealed").alias("state"), F.lit(SCHEMA_VERSION).alias("schema_version")
        )

    def seal(self, events: DataFrame, segment: int | None = None) -> int:
        """Write events (stream_id, source_offset, time, ...) as one segment with index_time and postings, then add it to the manifest; an id that is there is left alone."""
        have = {r[0] for r in self.manifest().select("segment_id").distinct().collect()}
        segment = max(have, default=-1) + 1 if segment is None else segment
        if segment in have:
            return segment
        running.number(events, ["stream_id"], "source_offset", "index_time").write.mode("overwrite").parquet(self._folder(segment))
        self._add(segment, [])
        return segment

    def _add(self, segment: int, instead_of: list[int]) -> None:
        written = self.spark.read.parquet(self._folder(segment))
        self._index(segment, written)
        self._swap(lambda m: m.filter(~F.col("segment_id").isin(*instead_of) if instead_of else F.lit(True)).union(self._row(segment, written)))

    def _index(self, segment: int, rows: DataFrame) -> None:
        if "tokens" in rows.columns:
            postings(rows.withColumn("segment_id", F.lit(segment).cast("bigint"))).select("term").write.mode("overwrite").parquet(f"{self.path}/terms/segment_id={segment}")

    def cursor(self) -> DataFrame:
        """stream_id and the last sealed offset."""
        return self.manifest().groupBy("stream_id").agg(F.max("last_offset").alias("source_offset"))

    def read(self, *, stream: str | None = None, offset: int | None = None, begin=None, end=None, terms: list[str] | None = None) -> tuple[DataFrame | None, dict]:
        """(events, coverage): only segments that can hold what is asked; missing ones are skipped and make the coverage partial."""
        m = self.manifest()
        wanted = m.filter("state = 'sealed'")
        if stream is not None:
            wanted = wanted.filter(F.col("stream_id") == stream)
        if offset is not None:
            wanted = wanted.filter((F.col("first_offset") <= offset) & (F.col("last_offset") >= offset))
        if begin is not None:
            wanted = wanted.filter(F.col("last_time").isNull() | (F.col("last_time") >= F.lit(begin)))
        if end is not None:
            wanted = wanted.filter(F.col("first_time").isNull() | (F.col("first_time") <= F.lit(end)))
        ids = sorted({r[0] for r in wanted.select("segment_id").collect()})
        if terms:
            indexed = self._indexed()
            held = self.postings()
            found = {r["segment_id"] for r in held.filter(F.col("term").isin(*terms)).groupBy("segment_id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(set(terms))).collect()} if indexed else set()
            ids = [i for i in ids if i in found or i not in indexed]
        there = self._names("data")
        missing = [i for i in ids if f"segment_id={i}" not in there]
        paths = [self._folder(i) for i in ids if i not in set(missing)]
        out = self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", "true").parquet(*paths).withColumn("segment_id", F.col("segment_id").cast("bigint")) if paths else None
        if out is not None and terms and "tokens" in out.columns:
            for t in terms:
                out = out.filter(F.array_contains("tokens", t))
        if out is not None:
            for c, v, op in (("stream_id", stream, "="), ("source_offset", offset, "="), ("time", begin, ">="), ("time", end, "<=")):
                if v is not None:
                    out = out.filter(F.col(c) == v if op == "=" else F.col(c) >= F.lit(v) if op == ">=" else F.col(c) <= F.lit(v))
        quarantined = sorted({r[0] for r in m.filter("state = 'quarantined'").select("segment_id").collect()})
        return out, {"segments": ids, "of": m.select("segment_id").distinct().count(), "missing": missing, "quarantined": quarantined, "partial": bool(missing or quarantined)}

    def verify(self) -> list[int]:
        """Recompute every segment's checksum; those that differ or cannot be read are quarantined, the others open."""
        bad = []
        for i in sorted({r[0] for r in self.manifest().filter("state = 'sealed'").select("segment_id").collect()}):
            told = self.manifest().filter(F.col("segment_id") == i)
            try:
                now = self._row(i, self.spark.read.parquet(self._folder(i)))
                keys = ["stream_id", "n", "checksum"]
                same = told.select(*keys).exceptAll(now.select(*keys)).isEmpty() and now.select(*keys).exceptAll(told.select(*keys)).isEmpty()
            except Exception:  # noqa: BLE001  whatever stops the reading makes the segment unusable
                same = False
            if not same:
                bad.append(i)
        if bad:
            self._swap(lambda m: m.withColumn("state", F.when(F.col("segment_id").isin(*bad), "quarantined").otherwise(F.col("state"))))
        return bad

    def compact(self, ids: list[int]) -> int:
        """Many segments become a new one; the manifest changes at once."""
        m = self.manifest()
        rows = self.spark.read.parquet(*map(self._folder, ids))
        new = m.agg(F.max("segment_id")).first()[0] + 1
        rows.repartitionByRange(max(1, rows.rdd.getNumPartitions() // 4), "stream_id", "source_offset").write.mode("overwrite").parquet(self._folder(new))
        self._add(new, ids)
        self._remove(ids)
        return new

    def evict(self, before) -> list[int]:
        """Whole segments that end before a time go."""
        m = self.manifest()
        ids = [r[0] for r in m.groupBy("segment_id").agg(F.max("last_time").alias("t")).filter(F.col("t") < F.lit(before)).collect()]
        if ids:
            self._swap(lambda m: m.filter(~F.col("segment_id").isin(*ids)))
            self._remove(ids)
        return sorted(ids)

    def _remove(self, ids: list[int]) -> None:
        for i in ids:
            for path in (self._folder(i), f"{self.path}/terms/segment_id={i}"):
                fs, p = self._fs(path)
                fs.delete(p, True)

    def _indexed(self) -> set[int]:
        """Segments whose postings are whole."""
        return {int(n.partition("=")[2]) for n in self._names("terms") if n.startswith("segment_id=") and self._done(f"terms/{n}")}

    def index_terms(self) -> None:
        """Write the postings of sealed segments that have none yet."""
        indexed = self._indexed()
        for i in sorted({r[0] for r in self.manifest().filter("state = 'sealed'").select("segment_id").collect()} - indexed):
            self._index(i, self.spark.read.parquet(self._folder(i)))

    def postings(self) -> DataFrame:
        """term and segment_id of all indexed segments."""
        paths = [f"{self.path}/terms/segment_id={i}" for i in sorted(self._indexed())]
        if not paths:
            return self.spark.createDataFrame([], "term string, segment_id bigint")
        return self.spark.read.option("basePath", f"{self.path}/terms").parquet(*paths).withColumn("segment_id", F.col("segment_id").cast("bigint"))


def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")


def postings(events: DataFrame, *, tokens: str = "tokens") -> DataFrame:
    """term and segment_id, each pair once."""
    return events.select("segment_id", F.explode(tokens).alias("term")).distinct()
