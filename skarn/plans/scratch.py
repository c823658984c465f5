"""Intermediate tables, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; on a cluster that is an error, since
    a folder of one machine isn't seen by the others. What is in it goes when the application ends.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            set_ = sc._jsc.sc().getCheckpointDir()
            base = set_.get() if set_.isDefined() else None
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="skarn-")
        _OWN[app] = f"{base}/skarn/{app}"
        fs, path = file_system(spark, _OWN[app])
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _OWN[app]


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system of the path, the path there)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends, lost executors do no harm."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what keep() wrote for df, once nothing will read it again; anything else is left alone."""
    path = df.__dict__.get("_kept_at")
    if path:
        fs, p = file_system(df.sparkSession, path)
        fs.delete(p, True)
