"""Distinct visitors that add up: bitmaps by hour from which any longer period follows without events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ranked


def numbers_of(tracks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(store_id, track, visitor_no): known numbers, and for tracks (store_id, track) that have none the next ones of their store, from 1. Numbers are dense, so bitmaps are full."""
    new = tracks.select("store_id", "track").where("store_id is not null and track is not null").distinct()
    if known is None:
        return ranked(new, ["store_id"], ["track"], "visitor_no")
    new = ranked(new.join(known, ["store_id", "track"], "left_anti"), ["store_id"], ["track"], "n")
    most = known.groupBy("store_id").agg(F.max("visitor_no").alias("most"))
    return known.select("store_id", "track", "visitor_no").union(new.join(most, "store_id", "left").select("store_id", "track", F.col("n") + F.coalesce("most", F.lit(0))))


def hourly_bitmaps(seen: DataFrame, numbers: DataFrame) -> DataFrame:
    """(store_id, bucket_start, block, bits): who of seen (store_id, bucket_start, track) was there, 32,768 visitors a block."""
    once = seen.select("store_id", "bucket_start", "track").distinct().join(numbers, ["store_id", "track"])
    return once.groupBy("store_id", "bucket_start", F.bitmap_bucket_number("visitor_no").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("visitor_no")).alias("bits"))


def merged_bitmaps(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Both, as one row a store, hour and block: what a later batch tells is added."""
    return stored.unionByName(more).groupBy("store_id", "bucket_start", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def visitors_by(bitmaps: DataFrame, period: str | None = None) -> DataFrame:
    """(store_id, period_start, visitors) from stored bitmaps: distinct visitors by hour, day, week or month, or of all time (None)."""
    start = F.date_trunc(period, F.col("bucket_start")).cast("timestamp_ntz") if period else F.lit(None).cast("timestamp_ntz")
    blocks = bitmaps.groupBy("store_id", start.alias("period_start"), "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return blocks.groupBy("store_id", "period_start").agg(F.sum(F.bitmap_count("bits")).alias("visitors"))
