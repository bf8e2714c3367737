"""Shared helpers: scratch tables in the cluster's shared folder, and word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most operators: runs of anything but space and tab to carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_root(spark)}/vecloom/{tag}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, to = _file_system(spark, path)
    out = fs.create(to, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def move_path(spark: SparkSession, path: str, to: str) -> None:
    fs, at = _file_system(spark, path)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't become {to}")


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    fs, at = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession):
    """Writes in here delete their shuffle files when they are done, not when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with dropping_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def released(run):
    """run, a function for mapInArrow, after whose tasks the worker gives the memory that they have freed back to the
    system: workers live on, idle ones too, and share their executor's memory with the JVM."""
    def inner(batches):
        yield from run(batches)
        _trim()

    return inner


def words(text: Column) -> Column:
    """Array of the text's words, built in; null text has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where a lambda inside body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_bytes(column: str = "text") -> Column:
    """The text as bytes, so that Arrow passes it on without decoding; null becomes empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
