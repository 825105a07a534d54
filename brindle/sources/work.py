"""Work tables: rows written once to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one of this machine if the session runs on this machine alone."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-brindle-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _goes_with(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table that goes with the application: cuts lineage, is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _goes_with(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, keys: list[str], order: list[str]) -> DataFrame:
    """``written`` in buckets by ``keys``, sorted in each: what groups by columns with the keys among them needs no shuffle. The
    rows of a bucket should be in one task already (``repartition(buckets, *keys)``), else every task writes a file for each."""
    spark, label = df.sparkSession, f"brindle_{name}_{uuid.uuid4().hex}"
    path = f"{work_folder(spark)}/{label}"
    df.write.bucketBy(buckets, *keys).sortBy(*order).option("path", path).saveAsTable(label, format="parquet")
    _goes_with(spark, path)
    return spark.table(label)
