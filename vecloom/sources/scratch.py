"""Tables that cut a plan's lineage, in the folder that a cluster shares for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """Makes sure that checkpoint() has a folder: spark.checkpoint.dir, or a local one where that is unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not root and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="vecloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{checkpoint_folder(spark)}/kept-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back; gone when the application ends.

    Loops use this and not checkpoint(), whose result keeps the size estimate of the plan it came from: after some rounds of
    joins that number is so large that planning takes longer than the work.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
