"""Intermediate tables in the folder that the cluster shares.

A staged table cuts lineage as ``checkpoint()`` does, but keeps columns, so later
reads prune what they do not need. It lies under ``spark.checkpoint.dir``; only where
that setting is absent and Spark runs in this process alone (tests, a laptop) does a
temporary folder take its place. On a cluster without the setting nothing is staged:
each executor would write to its own disk, and later reads would miss those files.
Losing an executor loses nothing: the files are not on executors' own disks.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def on_one_machine(spark: SparkSession) -> bool:
    """True if driver and executors are one process (``local`` masters)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one where no setting names it and Spark is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not on_one_machine(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = f"file://{folder}"
    return _LOCAL[app]


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return it as read back from the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def discard(staged: DataFrame, part: str = "") -> None:
    """Delete a staged table, or one of its partitions (``column=value``), that nothing will read again."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{staged._weft_path}/{part}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables that nothing refers to any more, which a collection settles."""
    gc.collect()
    spark._jvm.System.gc()
