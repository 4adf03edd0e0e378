"""Helpers that the operators share: tables, shared-folder checkpoints, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, read by Spark alone (the folder may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Where it is unset (local
    tests) one temporary folder is made for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.vellum.local.dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="vellum-")
            spark.conf.set("spark.vellum.local.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (a subfolder for each value of ``by``) and read it back.

    Cuts the lineage: a lost executor costs a reread, never a second run of what
    led here.  The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    return out


def dropped(df: DataFrame, part: str = "") -> None:
    """Delete what ``saved`` wrote for ``df``, or its subfolder ``part``; nothing may read it any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{df._vellum_path}/{part}".rstrip("/"))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of a column's text form, modulo ``n`` (how the contracts name folds)."""
    return F.crc32(F.col(column).cast("string")) % n


def row_key(*columns: str) -> Column:
    """Hash that spreads rows evenly, whatever key is hot."""
    return F.xxhash64(*[F.col(c) for c in columns])
