"""As-of joins: each row with the nearest row of another table, before or after it in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import time_ranges

_FIRST, _LAST = Window.unboundedPreceding, Window.currentRow


def _kept(value: str) -> Column:
    """The last `value` that is there."""
    return F.last(value, ignorenulls=True)


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, value: list[str]) -> DataFrame:
    """left with `before` and `after`: the last row of right at or before its time, and the first one after it, as structs of (at, *value), or null.

    Times are longs. Of rows of right at one time the smallest `value` counts; rows without a
    time or with a null key meet nothing. left's other columns may have any names.

    Both tables are one, in time ranges: no row is ever multiplied, and no task holds a key. In
    a range the last row seen goes along a window, forth and back; what a range needs from
    outside is the last one before it and the first one after it, and these follow from one row
    a range.
    """
    put = F.struct(F.col(right_at).alias("at"), *value)
    r = right.dropna(subset=[*by, right_at]).groupBy(*by, right_at).agg(F.min(put).alias("hit")).select(*by, F.col(right_at).alias("at_"), F.lit(0).alias("side"), F.lit(None).alias("row"), "hit")
    row = F.struct(*left.columns)
    both = left.select(*by, F.col(left_at).alias("at_"), F.lit(1).alias("side"), row.alias("row"), F.lit(None).alias("hit")).unionByName(r.withColumn("row", F.lit(None).cast(left.select(row.alias("row")).schema["row"].dataType)))
    part = time_ranges(both, by, ["at_", "side"])
    key = [*by, "range_no"]
    forth = Window.partitionBy(*key).orderBy("at_", "side").rowsBetween(_FIRST, _LAST)
    back = Window.partitionBy(*key).orderBy(F.desc("at_"), F.desc("side")).rowsBetween(_FIRST, _LAST)
    ends = part.groupBy(*key).agg(F.max("hit").alias("tail"), F.min("hit").alias("head"))
    outside = Window.partitionBy(*by)
    ends = ends.select(
        *key, _kept("tail").over(outside.orderBy("range_no").rowsBetween(_FIRST, -1)).alias("known"),
        _kept("head").over(outside.orderBy(F.desc("range_no")).rowsBetween(_FIRST, -1)).alias("coming"),
    )
    seen = part.withColumn("before", _kept("hit").over(forth)).withColumn("after", _kept("hit").over(back)).where("side = 1 and at_ is not null")
    got = seen.join(ends, key, "left").select("row", F.coalesce("before", "known").alias("before"), F.coalesce("after", "coming").alias("after"))
    return got.select("row.*", "before", "after").unionByName(
        left.where(F.col(left_at).isNull()).select("*", *(F.lit(None).cast(got.schema[c].dataType).alias(c) for c in ("before", "after")))
    )


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, value: list[str], within: int) -> DataFrame:
    """left with `hit` (distance, *value): of the rows of right within `within` of its time the nearest, of equally near ones the smallest `value`; null where there is none."""
    x = asof(left, right, by, left_at, right_at, value)
    far = lambda side: F.when(F.abs(F.col(left_at) - F.col(f"{side}.at")) <= within, F.struct(F.abs(F.col(left_at) - F.col(f"{side}.at")).alias("distance"), *(F.col(f"{side}.{v}").alias(v) for v in value)))
    return x.withColumn("hit", F.least(far("before"), far("after"))).drop("before", "after")
