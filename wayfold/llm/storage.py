"""Tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of tables to be removed, one list for each open temporary() block of this thread or task of the driver.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open_blocks", default=())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; on a cluster it must be set, in local runs (tests) a folder of this machine is set once."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that were materialized within, but for those to keep.

    Only for tables that nothing lazy reads any more: what goes out of the block must itself have been written with ``keep``.
    """
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            folder = hadoop(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so a lost executor never recomputes what came before.

    Every task writes its own file, so tasks stay as small as the scan's splits or the shuffle's partitions make them. In a temporary() block
    the table goes at the block's end; with ``keep`` it stays until the end of the block around that, if there is one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    scopes = _open.get()[:-1] if keep else _open.get()
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
