"""Pieces that several operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is small enough to be broadcast (at under 100 bytes a row).
BROADCAST_ROWS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see; set here only where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_siltstone_dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="siltstone-")  # one machine, as in tests
            spark.sparkContext._siltstone_dir = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/siltstone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(release, spark, path)
    return path


def release(spark: SparkSession, path: str) -> None:
    """Deletes a table of new_path(); at exit the JVM may be gone already, and then nothing is left to ask."""
    sc = spark.sparkContext
    if sc._jsc is None or getattr(sc._gateway, "proc", None) is not None and sc._gateway.proc.poll() is not None:
        return
    try:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  only at exit: the gateway may close at any moment
        return


def cut(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there, and lost executors cost no recomputation.

    instead_of is an earlier such table that nothing reads from now on; it is deleted.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if instead_of is not None:
        release(df.sparkSession, instead_of._siltstone_path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def pieces(batches, rows: int = 256):
    """Arrow batches in pieces of some rows, so that no more texts than these are Python strings at once.

    At a task's end memory that the worker no longer needs goes back to the system: the worker lives on.
    """
    libc = _libc()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    if libc is not None:
        libc.malloc_trim(0)


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    """The C library, where it is one that can be told to give memory back: blocks of 1 MB and more as soon as they are free."""
    if sys.platform != "linux":
        return None
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "malloc_trim") or not hasattr(libc, "mallopt"):
        return None
    libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows with what was freed last
    return libc


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks df for broadcast if it has at most BROADCAST_ROWS rows; else Spark shuffles, and AQE splits hot keys."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty.  ASCII texts take the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
