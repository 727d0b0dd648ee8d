"""Cutting lineage in loops: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; on a cluster it must be set, in local runs (tests) a folder of this machine is set once."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written as Parquet and read again: a lost executor recomputes nothing older, and plans of loops don't grow.

    A table that cut() gave earlier and that nothing but ``df`` reads any more is removed with ``instead_of``: a loop then leaves one table, not one a round.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if old := getattr(instead_of, "_scratch_path", None):
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return out
