"""Where plans are cut: tables that many others are made from are written once to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without one has a folder in the warehouse, a cluster an error."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not given and not context.master.startswith(("local[", "local")[context.master == "local"]):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Stored:
    """A table written to the shared folder; iterations drop the tables of the step before."""

    def __init__(self, df: DataFrame, tag: str):
        spark = df.sparkSession
        self.path = f"{shared_folder(spark)}/scholar_spark/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no pending plan reads."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers or a name that may be sent to all executors; beyond it a shuffle join does the same.
SENT_ROWS = 1_500_000


def sent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, whose ``rows`` were counted, marked for sending to all executors if they are few."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def numbered(df: DataFrame, order: list, by: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """Adds ``name``: 0, 1 ... in the order of ``order`` among the rows of each value of ``by``.

    Rows are dealt into ranges, so no task holds them all; the ranges' sizes (a row for each range and each
    value in it) are added up and joined back.
    """
    ranged = df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    ranged = Stored(ranged, "ranges").df
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range", *by).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    out = ranged.withColumn("_place", place).join(F.broadcast(starts.drop("_n")), ["_range", *by])  # as many rows as ranges and values
    return out.withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_range", "_start", "_place")
