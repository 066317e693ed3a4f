"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where none is named, a folder of our own if all
    runs in one process, and an error on a cluster: executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = getattr(spark, "_threadloom_dir", None) or "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark._threadloom_dir = found
    return found.rstrip("/")


def cut(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back, in ``spark`` or its own session: lineage ends there and lost executors lose nothing."""
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/threadloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark._threadloom_cut = [*getattr(spark, "_threadloom_cut", []), path]
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` wrote in this session, once all results that read them are written. Returns their number."""
    paths = getattr(spark, "_threadloom_cut", [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark._threadloom_cut = []
    return len(paths)
