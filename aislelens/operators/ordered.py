"""Ordered work on stores of any size: rows in time ranges, and one row a range to tie them together."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the setting is missing, a master on one machine gets a temporary folder; on a cluster it is an error."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known is None and sc._jsc.sc().getCheckpointDir().isDefined():
        known = sc._jsc.sc().getCheckpointDir().get()
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='checkpoint')}"
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again, so that partition numbers and random order stay as they are and lost executors are harmless."""
    folder = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def time_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df range-partitioned by (by, order), with range_no; ranges of a group follow each other in number."""
    return settled(df.repartitionByRange(*by, *order).withColumn("range_no", F.spark_partition_id()))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Numbers the rows of each group in `order` (a total order), from 1: a range by itself, plus the rows of the ranges before."""
    part = time_ranges(df, by, order)
    sizes = part.groupBy(*by, "range_no").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rn = F.row_number().over(Window.partitionBy(*by, "range_no").orderBy(*order))
    return part.join(sizes.select(*by, "range_no", before.alias("base")), [*by, "range_no"]).withColumn(name, F.col("base") + rn).drop("base", "range_no")


def chains(df: DataFrame, by: list[str], at: str, ties: list[str], gap: float) -> DataFrame:
    """df with `chain`: the number of gaps of more than `gap` in `at` before a row in its group."""
    part = time_ranges(df, by, [at, *ties])
    w = Window.partitionBy(*by, "range_no").orderBy(at, *ties)
    seen = part.withColumn("cut", F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("long"), F.lit(0).cast("long")))
    ends = seen.groupBy(*by, "range_no").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.sum("cut").alias("cuts"))
    r = Window.partitionBy(*by).orderBy("range_no")  # ranges, not rows
    ends = ends.withColumn("edge", F.coalesce((F.col("lo") - F.lag("hi").over(r) > gap).cast("long"), F.lit(0).cast("long")))
    ends = ends.withColumn("base", F.sum("edge").over(r) + F.coalesce(F.sum("cuts").over(r.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    chain = F.col("base") + F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return seen.join(ends.select(*by, "range_no", "base"), [*by, "range_no"]).withColumn("chain", chain).drop("cut", "base", "range_no")


def changes(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, changes): how often `value` differs from the row before it in its group; ranges hand their last value on."""
    part = time_ranges(df.where(F.col(value).isNotNull()), by, order)
    w = Window.partitionBy(*by, "range_no").orderBy(*order)
    seen = part.withColumn("new", (F.lag(value).over(w) != F.col(value)).cast("long"))
    key = F.struct(*order)
    ends = seen.groupBy(*by, "range_no").agg(F.sum("new").alias("n"), F.min_by(value, key).alias("head"), F.max_by(value, key).alias("tail"))
    edge = (F.lag("tail").over(Window.partitionBy(*by).orderBy("range_no")) != F.col("head")).cast("long")
    return ends.withColumn("edge", edge).groupBy(*by).agg((F.coalesce(F.sum("n"), F.lit(0)) + F.coalesce(F.sum("edge"), F.lit(0))).alias("changes"))
