"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"
_FIND_WORDS = re.compile(WORD).findall


def bound_batches(spark: SparkSession) -> None:
    """Texts are long: at most 1000 rows go to Python at once, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def bound_bytes(spark: SparkSession) -> None:
    """Rows of megabytes: at most 16 MB go to Python at once, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "64MB"):
        spark.conf.set(key, "16m")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset, as in
    local tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read again: lineage is cut, lost executors cost nothing done."""
    return stored(df, name, group_rows)[0]


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> tuple[DataFrame, str]:
    """As ``materialise``, with the path, which ``discard`` takes once nothing reads it any more.

    Readers hold a row group at once: where rows take megabytes, ``group_rows`` bounds it.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    with shuffles_dropped(spark):
        (writer.option("parquet.block.row.count.limit", str(group_rows)) if group_rows else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside go when it is done, as what was written is read from then on."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` wrote."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % modulus


def words_of(text: str | None) -> list[str]:
    """The words of a text, split at ASCII white space only (``str.split()`` also splits at Unicode's)."""
    return _FIND_WORDS(text) if text else []


_KEPT: list = []


def kept(make):
    """``make`` with its last two results, which a Python worker keeps from task to task until ``release_memory`` drops them."""
    out = lru_cache(maxsize=2)(make)
    _KEPT.append(out)
    return out


def release_memory(*still) -> None:
    """Drop what other operators' tasks left in this Python worker (all that is ``kept`` but ``still``), and give back what is
    free: allocators keep it otherwise."""
    for k in _KEPT:
        if k not in still:
            k.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


class TwoGenerationCache(dict):
    """A bounded memo: when the young half is full, it becomes the old half."""

    def __init__(self, compute, half: int):
        super().__init__()
        self.compute, self.half, self.old = compute, half, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
