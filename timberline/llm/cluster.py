"""Helpers for jobs that must survive lost executors and grow with the input.

Intermediate results are cut by writing Parquet into the shared folder that the
cluster names in ``spark.checkpoint.dir``; nothing is kept on one machine.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.shipping import ship

_written: list[tuple[SparkSession, str]] = []


#: Bytes of a batch that goes to a Python worker, where the session does not set its own.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Put this package on the executors, and keep batches small: workers hold texts, their words and results at once."""
    ship(spark)
    if spark.conf.get(_BATCH_CONF) in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; own temporary one only where none is set and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="timberline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/timberline-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str = "step", **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it; ``options`` are the writer's."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that may be broadcast.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 a field and element, and the lengths of strings and binaries."""

    def width(c: Column, kind: T.DataType) -> Column:
        eight = F.lit(8).cast("long")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return eight + F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(kind, T.StructType):
            return F.coalesce(sum((width(c[f.name], f.dataType) for f in kind.fields), eight), eight)
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if isinstance(inner, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
                return F.coalesce(F.aggregate(c, eight, lambda acc, x: acc + width(x, inner)), eight)
            return eight + 8 * F.coalesce(F.size(c), F.lit(0))
        return eight

    return sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8).cast("long"))


def broadcast_if(df: DataFrame, most_bytes: int) -> DataFrame:
    """Broadcast hint only if the rows of the (materialized) ``df`` have at most ``most_bytes`` bytes, else a shuffle join."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= most_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow, after which a reused worker gives its free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def _release() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone: the cluster cleans its folder
            return


atexit.register(_release)
