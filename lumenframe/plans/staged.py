"""Intermediate tables in the folder that all executors share: lineage ends there and survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Without one, a local session makes one; a cluster refuses."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="lumenframe-")).as_uri()  # one machine: it is shared by definition
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table goes with ``drop_table``, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumen_path = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes on disk of what ``stage_table`` wrote."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._lumen_path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def drop_table(df: DataFrame) -> None:
    """Delete what ``stage_table`` wrote, when nothing will read it again."""
    path = getattr(df, "_lumen_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
