"""Session helpers that the operators share: the shared folder, stage tables, exact type clean-up."""

from __future__ import annotations

import ctypes
import math
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a Python worker remembers between tasks: encoders, words. Workers outlive stages.
_HELD: dict = {}
_RELEASED = 0.0
#: Text bytes that one group of rows handed to a Python task holds, about.
GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without and gets an
    own one; on a cluster a machine's own folder would lose what others write."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="claraudit-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes a query's shuffle files when it ends: what it wrote is in the shared folder."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def staged(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark, at = df.sparkSession, at or stage_path(df.sparkSession, name)
    with freed_shuffles(spark):
        df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder through Hadoop's file system, whichever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def held(key: tuple, make: Callable[[], object]) -> object:
    """What this worker remembers under `key`, made where it isn't there; asking for another key forgets the rest."""
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """For tasks that remember nothing: drop what earlier stages left in this worker and give free memory back."""
    _HELD.clear()
    release(0)


def release(seconds: float = 0.25) -> None:
    """Give memory that this worker has freed back to the system, if that wasn't done in the last `seconds`: workers are
    many and live on from stage to stage, and allocators keep what they got."""
    global _RELEASED
    if time.monotonic() - _RELEASED >= seconds:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # the C library's own, where it has it
            ctypes.CDLL(None).malloc_trim(0)
        _RELEASED = time.monotonic()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def groups_for(spark: SparkSession, total: float, per_group: float, factor: int = 1) -> int:
    """How many groups hold `total` at about `per_group` each, and at least `factor` for each shuffle partition."""
    return max(1, factor * shuffle_partitions(spark), math.ceil(total / per_group))


def bucket(n: int, *cols: Column | str, salt: int = 0) -> Column:
    """A hash bucket from 0 to n-1."""
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(n)).cast("long")


def file_order(rows: DataFrame) -> DataFrame:
    """Rows read from files with their number, `_order`, from 0 on: by file name, then by place in the file."""
    numbered = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = numbered.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))  # a row a file
    files = files.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_first"))
    return numbered.join(F.broadcast(files), "_file").withColumn("_order", F.col("_first") + F.col("_at")).drop("_file", "_at", "_first")


def text_slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes together, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
