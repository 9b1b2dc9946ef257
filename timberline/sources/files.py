"""Sources of raw lines: files with byte offsets, standard input, journal exports, corpora, and appended files as a stream."""

from __future__ import annotations

import json
import os
import sys
import tomllib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from timberline.functions import scratch

RAW = "stream_id string, generation int, source_offset bigint, raw string"
_EVENT = {
    "event_id": "bigint", "ingestion_time": "timestamp", "event_time": "timestamp", "tz_source": "string", "resolution": "string", "lateness": "string", "index_time": "bigint", "severity": "string",
    "severity_source": "string", "attributes": "array<struct<key:string,value:string>>", "template_id": "bigint", "fingerprint": "bigint",
}


def read_files(spark: SparkSession, path: str, *, start: dict[str, int] | None = None) -> DataFrame:
    """Lines of files with the byte at which each begins; what is not UTF-8 is kept with U+FFFD in its place.

    Files are read in splits of ``spark.sql.files.maxPartitionBytes``, compressed ones whole. A first look sums up the bytes of
    each split's lines, a row a split, which gives where each split's first line begins; within a split offsets are running sums.
    ``start`` gives a first offset by file name.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    split = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file", "block").agg(F.sum(F.octet_length("line") + 1).alias("size"))
    begins = sizes.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("size").over(split), F.lit(0)).alias("begin"))
    rows = lines.mapInArrow(_places, "file string, block bigint, place bigint, line binary").join(begins, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    rows = rows.select(F.url_decode(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\+", "%2B")).alias("stream_id"), F.lit(0).alias("generation"), (F.col("begin") + F.col("place")).alias("source_offset"), F.regexp_replace(F.make_valid_utf8(F.col("line").cast("string")), r"\r\z", "").alias("raw"))
    if start:
        first = F.lit(0)
        for name, at in start.items():
            first = F.when(F.col("stream_id") == name, at).otherwise(first)
        rows = rows.filter(F.col("source_offset") >= first)
    return rows


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds where each line begins within its split; a split's lines come one after the other."""
    now, at = None, 0
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        sizes = pc.binary_length(batch.column("line")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        place = np.empty(len(sizes), dtype=np.int64)
        edges = [0, *(k for k in range(1, len(files)) if blocks[k] != blocks[k - 1] or files[k] != files[k - 1]), len(files)] if len(files) else []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if (files[lo], blocks[lo]) != now:
                now, at = (files[lo], blocks[lo]), 0
            ends = at + np.cumsum(sizes[lo:hi])
            place[lo:hi] = ends - sizes[lo:hi]
            at = int(ends[-1])
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(place), batch.column("line")], names=["file", "block", "place", "line"])


def write_file(rows: DataFrame, path: str, *, order: str, line: str) -> None:
    """One text file of the lines in order. Tasks write pieces of it; the driver puts their bytes one behind the other by the file system's
    own streams, a buffer at a time, so no task reads all rows."""
    spark = rows.sparkSession
    pieces = scratch.folder(spark, "pieces")
    rows.orderBy(order).select(line).write.text(pieces)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(pieces), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    try:
        # pieces are named by their task's number, which has five digits or more
        for piece in sorted((s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda p: int(p.getName().split("-")[1])):
            part = fs.open(piece)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()


def local_path(path: str) -> str:
    """The plain path of a folder in a mounted file system."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"a tail needs a folder that every executor mounts, not {path}")
    return "/" + rest.lstrip("/")


def read_stdin(spark: SparkSession, stream_id: str = "stdin", source=None) -> DataFrame:
    """Standard input to its end, as one batch."""
    rows, at = [], 0
    for line in source or sys.stdin:
        rows.append((stream_id, 0, at, line.rstrip("\n").removesuffix("\r")))
        at += len(line.encode())
    return spark.createDataFrame(rows, RAW)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """An exported journal (JSON lines): raw is MESSAGE, priority and unit come along; the order is the cursor's."""
    rows = spark.read.schema("MESSAGE string, PRIORITY string, _SYSTEMD_UNIT string, __REALTIME_TIMESTAMP string, __CURSOR string").json(path)
    at = F.col("__REALTIME_TIMESTAMP").try_cast("bigint")
    return rows.select(F.coalesce("_SYSTEMD_UNIT", F.lit("journal")).alias("stream_id"), F.lit(0).alias("generation"), at.alias("source_offset"), F.col("MESSAGE").alias("raw"), F.col("PRIORITY").alias("priority"))


def read_docker(spark: SparkSession, path: str) -> DataFrame:
    """Docker's json-file logs: one stream a file and channel, in order of the time they name."""
    rows = spark.read.schema("log string, stream string, time string").json(path)
    name = F.concat(F.element_at(F.split(F.input_file_name(), "/"), -1), F.lit(":"), F.coalesce("stream", F.lit("stdout")))
    at = F.unix_micros(F.try_to_timestamp(F.col("time")))
    return rows.select(name.alias("stream_id"), F.lit(0).alias("generation"), at.alias("source_offset"), F.regexp_replace("log", r"\n\z", "").alias("raw"))


def raw_events(lines: DataFrame) -> DataFrame:
    """Events of raw lines: all that is derived is null."""
    have = [c for c in ("stream_id", "generation", "source_offset", "raw") if c in lines.columns]
    return lines.select(*have, *(F.lit(None).cast(kind).alias(name) for name, kind in _EVENT.items()))


def generations(snapshots: DataFrame) -> DataFrame:
    """generation of each snapshot (stream_id, seen_at, identity, size): it grows when the file's identity changes or its size shrinks."""
    order = Window.partitionBy("stream_id").orderBy("seen_at")
    fresh = (F.lag("identity").over(order) != F.col("identity")) | (F.lag("size").over(order) > F.col("size"))
    rows = snapshots.withColumn("__fresh", F.coalesce(fresh, F.lit(False)).cast("int"))
    return rows.withColumn("generation", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("__fresh")


def load_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, labels, templates) of a labelled corpus: a TOML manifest, and by format input.log, labels.jsonl and templates.json. A small fixture, read by the driver."""
    with open(os.path.join(root, "manifest.toml"), "rb") as f:
        formats = tomllib.load(f)["format"]
    lines, labels, templates = [], [], []
    for spec in formats:
        folder = os.path.join(root, spec["path"])
        with open(os.path.join(folder, "input.log"), encoding="utf-8", newline="") as f:
            text = f.read()
        own = [x.removesuffix("\r") for x in text.split("\n")]
        own = own[:-1] if own and own[-1] == "" else own
        with open(os.path.join(folder, "labels.jsonl"), encoding="utf-8") as f:
            told = [json.loads(x) for x in f if x.strip()]
        if len(own) != len(told) or len(own) != spec["lines"]:
            raise ValueError(f"{spec['id']}: {len(own)} lines, {len(told)} labels, {spec['lines']} in the manifest")
        if [x["line"] for x in told] != list(range(1, len(told) + 1)):
            raise ValueError(f"{spec['id']}: labels are not contiguous")
        lines += [(spec["id"], i + 1, x) for i, x in enumerate(own)]
        labels += [(spec["id"], x["line"], x["template_gid"], x.get("severity"), x.get("severity_source")) for x in told]
        with open(os.path.join(folder, "templates.json"), encoding="utf-8") as f:
            templates += [(spec["id"], gid, p) for gid, p in json.load(f).items()]
    return (
        spark.createDataFrame(lines, "format_id string, line bigint, raw string"),
        spark.createDataFrame(labels, "format_id string, line bigint, template_gid string, severity string, severity_source string"),
        spark.createDataFrame(templates, "format_id string, template_gid string, pattern string"),
    )


class _Piece(InputPartition):
    def __init__(self, folder: str, file: str, inode: int, stream: str, generation: int, begin: int, end: int, first: bool):
        self.folder, self.file, self.inode, self.stream, self.generation, self.begin, self.end, self.first = folder, file, inode, stream, generation, begin, end, first


def _line_end(path: str, at: int, size: int) -> int:
    """The place behind the last line feed from ``at`` to ``size``, however long the last line is; ``at`` if there is none."""
    with open(path, "rb") as f:
        while size > at:
            begin = max(at, size - (1 << 16))
            f.seek(begin)
            found = f.read(size - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            size = begin
    return at


def _mark(path: str, at: int) -> int:
    """A checksum of the bytes before a place: another one tells a file that was cut off and grew again."""
    with open(path, "rb") as f:
        f.seek(max(0, at - 64))
        return zlib.crc32(f.read(min(at, 64)))


class _TailReader(DataSourceStreamReader):
    """Offsets are, by inode: the file's name now, its stream (the name it was first seen by), generation, the byte behind its last whole
    line, and a checksum of what stands before that byte.

    A file that is renamed keeps its stream and generation until its last line, so a rotated one is drained under its old name; the new
    file of that name is the stream's next generation, and so is a file that was cut off. A reader that starts anew does not know yet
    what was read; it leaves stream and generation open until Spark names the start of the batch.
    """

    def __init__(self, folder: str, piece: int):
        self.folder, self.piece = folder, piece
        self.state: dict[str, dict] = {}
        self.known = False

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = {}
        for name in sorted(os.listdir(self.folder)):
            path = os.path.join(self.folder, name)
            if not os.path.isfile(path):
                continue
            stat = os.stat(path)
            key = str(stat.st_ino)
            if self.known:
                one = self._next(key, name, path, stat.st_size, {**self.state, **now})
            else:
                one = {"file": name, "stream": "", "generation": -1, "at": _line_end(path, 0, stat.st_size), "mark": 0}
            now[key] = {**one, "mark": _mark(path, one["at"])}
        # files that are gone stay until their stream's next batch, which may still read them
        return {**{k: v for k, v in self.state.items() if os.path.exists(os.path.join(self.folder, v["file"]))}, **now}

    def _next(self, key: str, name: str, path: str, size: int, held: dict[str, dict]) -> dict:
        old = held.get(key)
        if old is not None and size >= old["at"] and _mark(path, old["at"]) == old["mark"]:
            return {**old, "file": name, "at": _line_end(path, old["at"], size)}
        stream = name if old is None or old["file"] != name else old["stream"]
        last = max((v["generation"] for v in held.values() if v["stream"] == stream), default=-1)
        return {"file": name, "stream": stream, "generation": last + 1, "at": _line_end(path, 0, size), "mark": 0}

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        out, told = [], {}
        for key, e in end.items():
            path, before = os.path.join(self.folder, e["file"]), start.get(key)
            goes_on = before is not None and e["at"] >= before["at"] and os.path.exists(path) and _mark(path, before["at"]) == before["mark"]
            if e["generation"] < 0:
                same = goes_on and before["generation"] >= 0
                stream = before["stream"] if same else e["file"]
                last = max((v["generation"] for v in {**start, **told}.values() if v["stream"] == stream), default=-1)
                e = {**e, "stream": stream, "generation": before["generation"] if same else last + 1}
            told[key] = e
            open_start = goes_on and before["generation"] < 0
            begin = before["at"] if open_start or (before is not None and (before["generation"], before["stream"]) == (e["generation"], e["stream"])) else 0
            for at in range(begin, e["at"], self.piece):
                out.append(_Piece(self.folder, e["file"], int(key), e["stream"], e["generation"], at, min(at + self.piece, e["at"]), at == begin))
        if not self.known:
            self.state, self.known = {**start, **told}, True
        return out

    def read(self, piece: _Piece) -> Iterator[tuple]:
        path = os.path.join(piece.folder, piece.file)
        if not os.path.exists(path) or os.stat(path).st_ino != piece.inode:
            # renamed since the batch was planned
            path = next(p for p in (os.path.join(piece.folder, n) for n in os.listdir(piece.folder)) if os.stat(p).st_ino == piece.inode)
        with open(path, "rb") as f:
            if piece.first:
                f.seek(piece.begin)
            else:
                # the line that runs into this piece is that of the one before
                f.seek(piece.begin - 1)
                f.readline()
            at = f.tell()
            while at < piece.end:
                line = f.readline()
                yield piece.stream, piece.generation, at, line.removesuffix(b"\n").decode("utf-8", "replace").removesuffix("\r")
                at += len(line)

    def commit(self, end: dict) -> None:
        self.state = {k: {**v, **({"stream": self.state[k]["stream"], "generation": self.state[k]["generation"]} if v["generation"] < 0 and k in self.state else {})} for k, v in end.items()}


class TailSource(DataSource):
    """``readStream.format("line_tail").option("path", folder)``: lines appended to files, with rotation and truncation. A batch takes
    all whole lines that are there, in tasks of ``maxBytesPerTask``; a line may be longer. Nothing is dropped. The folder must be one that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return RAW

    def streamReader(self, schema) -> _TailReader:
        return _TailReader(self.options["path"], int(self.options.get("maxBytesPerTask", 16 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
