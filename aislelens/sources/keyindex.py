"""A store of events with Bloom filters beside its partitions: a batch reads only partitions that may hold its keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import split_new_events

#: Bits of a block (what bitmap_construct_agg makes), bits a key sets in its block, and bits a key has room for.
BLOCK_BITS, HASHES, BITS_PER_KEY = 32_768, 7, 16
KINDS = ("event_id", "idempotency_key")


def _hashed(df: DataFrame) -> DataFrame:
    """(kind, key_hash, spots) of both keys of df, with its other columns: the hash that tells the block, and the bits inside it."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in KINDS))
    keys = df.withColumn("x", F.explode(pairs)).where("x.key is not null").drop(*KINDS)
    spots = F.array(*(F.pmod(F.xxhash64("x.key", F.lit(i + 1)), F.lit(BLOCK_BITS)).cast("int") for i in range(HASHES)))
    return keys.select("*", F.col("x.kind").alias("kind"), F.xxhash64("x.key").alias("key_hash"), spots.alias("spots")).drop("x")


def _block(level: Column) -> Column:
    """Block of a key where a partition has 2**level blocks."""
    return F.pmod(F.col("key_hash"), F.shiftleft(F.lit(1).cast("long"), 62)) % F.pow(F.lit(2.0), level).cast("long")


def _is_set(bits: Column, spot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (F.floor(byte / F.pow(F.lit(2.0), spot % 8)) % 2) == 1


class EventStore:
    """Events (event_id, idempotency_key, ...) in partitions by a text column, in `folder`. (K-01, J-10, S-20)

    rows/part_=<value> holds events, index a Bloom filter for each partition, load and kind of
    key: 2**level blocks of 32,768 bits, a key in one of them, so that a filter grows with its
    partition. A filter has no false "no", so outcomes are those of split_new_events() on the
    whole store. A load's rows are written before its filters: what has no filter (a crash
    between) counts as one that may hold any key.
    """

    def __init__(self, spark: SparkSession, folder: str, part: str):
        self.spark, self.folder, self.part = spark, folder.rstrip("/"), part

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def append(self, new: DataFrame) -> None:
        """Adds events; the caller has judged them with outcomes()."""
        load = f"l{uuid.uuid4().hex}"  # letters in front keep both columns text when read back
        rows = new.withColumn("load", F.lit(load)).withColumn("part_", F.concat(F.lit("p"), F.coalesce(F.col(self.part).cast("string"), F.lit(""))))
        rows.write.mode("append").partitionBy("part_", "load").option("compression", "zstd").parquet(f"{self.folder}/rows")
        mine = self.spark.read.parquet(f"{self.folder}/rows").where(F.col("load") == load).select("part_", "load", *KINDS)
        sizes = mine.groupBy("part_").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") * BITS_PER_KEY / BLOCK_BITS))).cast("int").alias("level"))
        keys = _hashed(mine).join(sizes, "part_").withColumn("block", _block(F.col("level")))
        bits = keys.select("part_", "load", "level", "kind", "block", F.explode("spots").alias("spot")).groupBy("part_", "load", "level", "kind", "block").agg(F.bitmap_construct_agg("spot").alias("bits"))
        bits.write.mode("append").parquet(f"{self.folder}/index")

    def parts_of(self, batch: DataFrame) -> list[tuple[str, str]]:
        """(partition, load) pairs that may hold a key of the batch: as many as there are, not rows.

        A batch's keys are grouped by block first, and a filter's block meets its group once.
        """
        loads = self.spark.read.parquet(f"{self.folder}/rows").select("part_", "load").distinct()
        if not self._there("index"):
            return sorted((r["part_"], r["load"]) for r in loads.collect())
        index = self.spark.read.parquet(f"{self.folder}/index")
        levels = [r["level"] for r in index.select("level").distinct().collect()]
        wanted = _hashed(batch.select(*KINDS)).withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels)))))
        groups = wanted.withColumn("block", _block(F.col("level"))).groupBy("level", "kind", "block", F.pmod("key_hash", F.lit(64)).alias("slice")).agg(F.collect_set("spots").alias("wanted"))
        hit = F.exists("wanted", lambda spots: F.forall(spots, lambda s: _is_set(F.col("bits"), s)))
        may = index.join(groups, ["level", "kind", "block"]).where(hit).select("part_", "load").distinct()
        unknown = loads.join(index.select("part_", "load").distinct(), ["part_", "load"], "left_anti")
        return sorted((r["part_"], r["load"]) for r in may.union(unknown).collect())

    def candidates(self, batch: DataFrame) -> DataFrame:
        """Stored keys of the partitions that may hold a key of the batch; the scan prunes the others."""
        stored = self.spark.read.parquet(f"{self.folder}/rows")
        by: dict[str, list[str]] = {}
        for part, load in self.parts_of(batch):
            by.setdefault(load, []).append(part)
        keep = F.lit(False)
        for load, parts in by.items():
            keep = keep | ((F.col("load") == load) & F.col("part_").isin(parts))
        return stored.where(keep).select(*KINDS)

    def outcomes(self, batch: DataFrame) -> DataFrame:
        """batch (idx, event_id, idempotency_key, ...) with outcome created, duplicate_id or duplicate_key."""
        if not self._there("rows"):
            return split_new_events(batch, batch.where("false").select(*KINDS))
        return split_new_events(batch, self.candidates(batch))
