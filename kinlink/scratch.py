"""The scratch folder that driver and executors share, and tables in it."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no shared folder (single-machine runs and tests).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
_LOCAL: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; the session's spark.checkpoint.dir. Only a session whose executors are
    in this process may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_CHECKPOINTS
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's part of the shared folder, which can go when the application has ended."""
    root = scratch_root(spark)
    own = f"{root}/kinlink/{spark.sparkContext.applicationId}"
    if root == LOCAL_CHECKPOINTS and own not in _LOCAL:
        _LOCAL.add(own)
        atexit.register(shutil.rmtree, own.removeprefix("file://"), True)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans that are no longer reachable."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from files that outlive executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    release_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)
