"""What the operators of this subpackage share: inputs, written work tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a folder of this machine if the session runs on
    this machine alone (tests); on a cluster that is an error, since other machines would not see it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-brindle-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_SCOPES: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors. The folder
    goes with the application, or earlier (``only_result``)."""
    path = f"{work_root(df.sparkSession)}/brindle-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _file_system(df.sparkSession, path)
    files.deleteOnExit(at)
    for scope in _SCOPES:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only_result(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; the work tables that it wrote on the way are deleted, the result stands on its own."""
    _SCOPES.append([])
    try:
        out = written(make(), name)
    finally:
        paths = _SCOPES.pop()
    for path in paths[:-1]:
        files, at = _file_system(spark, path)
        files.delete(at, True)
    return out


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``limit`` rows, else as it is (then a shuffled join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def tasks_for(spark: SparkSession, rows: int, rows_a_task: int) -> int:
    """Partitions for ``rows`` that are heavier than Spark's defaults assume."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_a_task))


#: Bands of a hash to each doubling of it.
BANDS = 32


def sampled(df: DataFrame, group: str, id_col: str, most: int) -> DataFrame:
    """Rows of ``df`` with at most ``most`` rows of each group, chosen by a hash of their ids, the same in every run.

    Rows are counted by group and band of the hash (combined in each task first). Bands grow in proportion to the hash, so
    there are 64 * ``BANDS`` of them at most and a group of any size has bands that are small beside ``most``; a group's bands
    are taken from the lowest on as long as they fit, so no group's rows are ever sorted or gathered. Rows that share an id
    share a band; a group whose first band is too large for itself - one id with more than ``most`` rows - gives that band."""
    height = F.shiftrightunsigned(F.xxhash64(id_col), 1).cast("double")
    banded = df.withColumn("_band", F.floor(BANDS * F.log2(height + 1.0)))
    counts = banded.groupBy(group, "_band").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy("_band")
    ranked = counts.select(group, "_band", F.sum("_n").over(upto).alias("_upto"), F.row_number().over(upto).alias("_nth"))
    last = written(ranked.where((F.col("_upto") <= most) | (F.col("_nth") == 1)).groupBy(group).agg(F.max("_band").alias("_last")), "bands")
    return banded.join(small(last), group).where("_band <= _last").drop("_band", "_last")


def text_or_empty(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def with_row_key(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``_r1`` and ``_r2``: 128 bits of hash over ``columns``, the same in every run; equal rows share them."""
    return df.withColumns({"_r1": F.xxhash64(*columns), "_r2": F.xxhash64(F.lit("row"), *reversed(columns))})


def restored(out: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that an operator was given, under their names before it renamed those that clash with its results."""
    return out.select(*[F.col(f"`{c}_in`").alias(c) if f"{c}_in" in out.columns and f"{c}_in" not in columns else F.col(f"`{c}`") for c in columns])
