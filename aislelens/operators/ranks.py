"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import time_ranges


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, name for each of shares): the value at rank share * (n - 1) of the group's values in order, between two of them in proportion. Nulls don't count; a group without values has null.

    Equal values are counted first, so a value that many rows have is one row. Counts by range
    of values tell which range holds a rank, and only rows of such ranges are put in order. No
    task holds a group.
    """
    # Groups as one struct, so that null keys are groups too.
    counted = df.where(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("key"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    part = time_ranges(counted, ["key"], ["v"])
    sums = part.groupBy("key", "range_no").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("range_no"))).withColumn("all_", F.sum("n").over(Window.partitionBy("key")))
    at = lambda s: F.lit(float(s)) * (F.col("all_") - 1)
    wish = F.array(*(F.struct(F.lit(name).alias("name"), f(at(s)).cast("long").alias("rank"), F.lit(k).alias("side")) for name, s in shares.items() for k, f in enumerate((F.floor, F.ceil))))
    wanted = sums.withColumn("before", F.col("upto") - F.col("n")).select("key", "range_no", "before", "upto", F.explode(wish).alias("x")).where("x.rank >= before and x.rank < upto")
    needed = wanted.groupBy("key", "range_no").agg(F.first("before").alias("before"), F.collect_list("x").alias("wishes"))
    inside = Window.partitionBy("key", "range_no").orderBy("v")
    ranked = part.join(needed, ["key", "range_no"]).withColumn("until", F.col("before") + F.sum("n").over(inside))
    hits = ranked.select("key", "v", "n", "until", F.explode("wishes").alias("x")).where("x.rank < until and x.rank >= until - n")
    pick = lambda name, side: F.max(F.when((F.col("x.name") == name) & (F.col("x.side") == side), F.col("v")))
    found = hits.groupBy("key").agg(*(pick(name, side).alias(f"{name}_{side}") for name in shares for side in (0, 1)))
    out = found.join(sums.groupBy("key").agg(F.max("all_").alias("all_")), "key")
    between = lambda name, s: F.col(f"{name}_0") + (F.col(f"{name}_1") - F.col(f"{name}_0")) * (at(s) - F.floor(at(s)))
    got = df.select(F.struct(*by).alias("key")).distinct().join(out.select("key", *(between(name, s).alias(name) for name, s in shares.items())), "key", "left")
    return got.select("key.*", *shares)
