"""Shared storage for intermediate tables.

Everything a job materialises between stages goes to the folder the session names in
``spark.checkpoint.dir`` (or by ``setCheckpointDir``). There is no fallback: a folder that only one machine sees would make later reads
miss rows without an error, so an unset folder is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share."""
    configured = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    return configured.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rankmill-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call uses."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a result that several later steps read: it is computed once, its columns can still be pruned, and a
    lost executor never brings back the work before it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
