"""The folder that driver and executors share, and tables written into it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Folders written by this process and not yet removed.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; on a cluster
    it is an error, as executors would write to their own disks.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set(SETTING, base)
    path = f"{base.rstrip('/')}/lectern/{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage with files that every executor can read, so a lost
    executor costs at most the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Remove what this process wrote, once no result reads it any more; the number of folders removed."""
    jvm, conf, removed = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed
