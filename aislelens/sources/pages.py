"""Deep pages: a table in order with counts by range, so that a page reads the ranges it is in."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST = 500


class PagedTable:
    """A table written in ranges of (by, order), and an index of rows by group and range. (S-07, S-12..S-14, T-03)

    order: columns with their direction, a total order together. A page of one group sums the
    index (a row a range) up to its offset, and reads and sorts one range, or two where it goes
    over an edge, however deep it is.
    """

    def __init__(self, spark: SparkSession, folder: str, by: str, order: list[tuple[str, bool]]):
        self.spark, self.folder, self.by, self.order = spark, folder.rstrip("/"), by, order

    def _sorted(self) -> list[Column]:
        return [F.desc(c) if down else F.asc(c) for c, down in self.order]

    def write(self, df: DataFrame, ranges: int | None = None) -> None:
        """ranges: how many; left to Spark if not given."""
        keys = [F.asc(self.by), *self._sorted()]
        part = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
        part.withColumn("range_no", F.spark_partition_id()).withColumn("group_", F.col(self.by)).sortWithinPartitions(*keys).write.partitionBy("range_no").option("compression", "zstd").parquet(f"{self.folder}/rows")
        self.spark.read.parquet(f"{self.folder}/rows").groupBy("group_", "range_no").agg(F.count("*").alias("n")).write.parquet(f"{self.folder}/index")

    def ranges_of(self, group: Any, offset: int, limit: int) -> list[tuple[int, int]]:
        """(range, rows of the group before it) of the ranges that hold a page: at most `limit` + 1 of them, as none is empty."""
        index = self.spark.read.parquet(f"{self.folder}/index").where(F.col("group_") == group)
        upto = F.sum("n").over(Window.orderBy("range_no"))  # one row a range of one group
        found = index.withColumn("before", upto - F.col("n")).where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
        return [(r["range_no"], r["before"]) for r in found.orderBy("range_no").collect()]

    def page(self, group: Any, offset: int = 0, limit: int = MOST) -> DataFrame:
        """Rows `offset` to `offset + limit` of a group in order, at most MOST of them."""
        offset, limit = max(0, offset), max(0, min(limit, MOST))
        stored = self.spark.read.parquet(f"{self.folder}/rows")
        columns = [c for c in stored.columns if c not in ("range_no", "group_")]
        ranges = self.ranges_of(group, offset, limit) if limit else []
        mine = stored.where(F.col("range_no").isin([r for r, _ in ranges]) & (F.col("group_") == group))
        skip = offset - ranges[0][1] if ranges else 0
        return mine.orderBy(*self._sorted()).offset(skip).limit(limit).select(*columns)
