"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on a single machine without that setting, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="keytide-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives a lost executor. ``discard`` deletes the table again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._keytide_table = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read any more; what ``materialise`` did not return is passed over. With KEEP_SCRATCH set they stay."""
    if os.environ.get("KEEP_SCRATCH"):
        return
    for t in tables:
        path = getattr(t, "_keytide_table", None)
        if path:
            sc = t.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
