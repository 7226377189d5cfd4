"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: The folder below the shared one that the current :func:`scratch` owns.
_OWNED: ContextVar[str] = ContextVar("owned", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Where that is unset, a folder of this process is
    made and set in local mode only: on a cluster each executor would write its own disk, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gradelake-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again: lineage is cut, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_OWNED.get()}{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """As :func:`stored`, with aggregates of the rows that are taken while they are written, so that no job of their own reads them again."""
    seen = Observation()
    table = stored(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), name)
    return table, seen.get


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owner of all tables that are stored inside it; they are deleted at its end.

    What an operator returns reads its stored tables lazily, so write the result elsewhere before the end.
    """
    name = f"scratch-{uuid.uuid4().hex}/"
    mark = _OWNED.set(name)
    try:
        yield
    finally:
        _OWNED.reset(mark)
        removed(spark, shared_dir(spark) + "/" + name)


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``row``, so that they never meet an operator's own names."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def wide_hash(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds; together 128 bits, so that equality of hashes is equality of values."""
    return [F.xxhash64(F.lit(11), *cols), F.xxhash64(F.lit(10_007), *cols)]


def release() -> None:
    """Hand freed memory back to the system: Spark keeps Python workers for later tasks, with all they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """The task, with its memory handed back at the end."""

    def run(*args) -> Iterator:
        try:
            yield from task(*args)
        finally:
            release()

    return run
