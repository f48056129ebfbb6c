"""Cross-camera identity evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordered import changes


def presence(events: DataFrame) -> DataFrame:
    """Vision events of a track on a camera: how many, from when to when, in which zone types. (A-34)"""
    e = events.where(F.col("event_type").startswith("vision.") & (F.coalesce("external_track_id", F.lit("")) != "") & (F.coalesce("camera_id", F.lit("")) != ""))
    return e.groupBy("store_id", "external_track_id", "camera_id").agg(
        F.count("*").alias("events"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.array_sort(F.collect_set(F.nullif("zone_type", F.lit("")))).alias("zone_types")
    )


def cross_camera(p: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Tracks seen by two cameras or more, with their path in order of first sight; cameras without a name by their last four characters. (A-35, F-17, F-18, J-14)"""
    label = F.coalesce(C.lookup(names, F.col("camera_id")), F.right("camera_id", F.lit(4))) if names else F.col("camera_id")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_at", "camera_id", label.alias("name")))), lambda x: x["name"]), " → ")
    t = p.groupBy("store_id", "external_track_id").agg(F.count("*").alias("cameras"), F.sum("events").alias("events"), path.alias("path")).where("cameras >= 2")
    return t.withColumn("suffix", F.right(F.substring_index("external_track_id", ":", -1), F.lit(12)))


def cross_camera_order() -> list:
    """Most cameras first, then most events. (T-04)"""
    return [F.desc("cameras"), F.desc("events"), F.asc("store_id"), F.asc("external_track_id")]


def camera_counts(p: DataFrame) -> DataFrame:
    """Tracks of a store, those of one camera and those of several. (A-35)"""
    t = p.groupBy("store_id", "external_track_id").agg(F.count("*").alias("n"))
    return t.groupBy("store_id").agg(F.count("*").alias("unique_tracks"), F.count_if(F.col("n") == 1).alias("single_camera"), F.count_if(F.col("n") > 1).alias("cross_camera"))


def handoffs(p: DataFrame, edges: DataFrame, max_gap_s: int = 210) -> DataFrame:
    """Track A leaves a camera and another track B comes up on a neighbouring one within the edge's gap. (J-08, F-25)

    edges (src, dst, priority, gap_s) is a small table; gap_s at most max_gap_s. A band join on
    buckets of that width; no all-pairs step.
    """
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    width = max_gap_s * 1_000_000
    a = p.select("store_id", F.col("external_track_id").alias("from_track"), F.col("camera_id").alias("src"), us("last_at").alias("left_at")).join(F.broadcast(edges), "src")
    a = a.withColumn("slot", F.explode(F.array(F.floor(F.col("left_at") / width), F.floor(F.col("left_at") / width) + 1)))
    b = p.select("store_id", F.col("external_track_id").alias("to_track"), F.col("camera_id").alias("dst"), us("first_at").alias("came_at")).withColumn("slot", F.floor(F.col("came_at") / width))
    gap = (F.col("came_at") - F.col("left_at")) / 1e6
    hit = a.join(b, ["store_id", "dst", "slot"]).where((F.col("from_track") != F.col("to_track")) & (gap >= 0) & (gap <= F.col("gap_s")))
    return hit.select("store_id", "src", "dst", "priority", "from_track", "to_track", gap.alias("gap_seconds"), F.lit("temporal_handoff_unlinked_ids").alias("reason"))


def handoff_order() -> list:
    """Shortest gaps first. (T-05)"""
    return [F.asc("gap_seconds"), F.asc("store_id"), F.asc("from_track"), F.asc("to_track"), F.asc("src"), F.asc("dst")]


def id_switches(events: DataFrame) -> DataFrame:
    """Changes of track between consecutive events of a camera. (W-07) A camera's events are cut into time ranges that hand their last track on."""
    tracks = events.groupBy("store_id", "camera_id", "external_track_id").count().groupBy("store_id", "camera_id").agg(F.count("external_track_id").alias("tracks"))
    n = changes(events.select("store_id", "camera_id", "occurred_at", "event_id", "external_track_id"), ["store_id", "camera_id"], ["occurred_at", "event_id"], "external_track_id")
    return tracks.join(n, ["store_id", "camera_id"], "left").select("store_id", "camera_id", F.coalesce("changes", F.lit(0)).alias("switches"), "tracks")


def reid_metrics(frames: DataFrame, sessions: DataFrame, expected_visitors: int, expected_sessions: int) -> DataFrame:
    """Frame tracks (camera_id, local_track_id, global_id, is_staff, ts) and sessions (external_track_id, staff) -> ids, fragments, switches, links and scores of identity. (A-54)

    A switch is a local track whose id differs from the one before on its camera.
    """
    g = frames.groupBy("global_id").agg(F.bool_or("is_staff").alias("staff"), F.size(F.collect_set("camera_id")).alias("cams"))
    ids = g.agg(F.count("*").alias("unique_ids"), F.count_if(~F.col("staff")).alias("visitor_ids"), F.count_if(F.col("cams") >= 2).alias("links"), F.coalesce(F.max(F.when(~F.col("staff"), F.col("cams"))), F.lit(0)).alias("top_cameras"))
    w = Window.partitionBy("camera_id", "local_track_id").orderBy("ts", "global_id")
    local = frames.withColumn("was", F.lag("global_id").over(w)).groupBy("camera_id", "local_track_id").agg(F.count_if(F.col("was") != F.col("global_id")).alias("n"))
    cuts = local.agg(F.count("*").alias("fragments"), F.coalesce(F.sum("n"), F.lit(0)).alias("switches"))
    s = sessions.where("not staff").groupBy("external_track_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("visitor_sessions"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_sessions"))
    near = lambda x, n: F.greatest(F.lit(0.0), 1 - F.abs(F.col(x) - n) / max(n, 1))
    rate = F.col("switches") / F.greatest("fragments", F.lit(1))
    bonus = F.least(F.lit(1.0), F.col("top_cameras") / 4.0)
    score = 0.35 * near("visitor_ids", expected_visitors) + 0.25 * near("visitor_sessions", expected_sessions) + 0.20 * (1 - F.least(F.lit(1.0), rate * 4)) + 0.20 * bonus
    return ids.crossJoin(F.broadcast(cuts)).crossJoin(F.broadcast(s)).select(  # one row each
        "*", F.round(near("visitor_ids", expected_visitors), 4).alias("visitor_id_accuracy"), F.round(near("visitor_sessions", expected_sessions), 4).alias("session_accuracy"),
        F.round(rate, 4).alias("id_switch_rate"), F.round(bonus, 4).alias("link_score"), F.round(score, 4).alias("overall_score"),
    )


def movement(frames: DataFrame, history: int = 120) -> DataFrame:
    """Path length of each track so far, net way over its last foot points, and their ratio. (W-09, ST-09's input)"""
    w = Window.partitionBy("store_id", "camera_id", "local_track_id").orderBy("ts", "event_id")
    step = F.hypot(F.col("foot_x") - F.lag("foot_x").over(w), F.col("foot_y") - F.lag("foot_y").over(w))
    tail = w.rowsBetween(-(history - 1), 0)
    net = F.hypot(F.col("foot_x") - F.first("foot_x").over(tail), F.col("foot_y") - F.first("foot_y").over(tail))
    x = frames.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("path_length", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("net", net).withColumn("points", F.count("*").over(tail))
    return x.withColumn("loiter_ratio", F.col("path_length") / F.greatest("net", F.lit(0.005))).drop("step")


def shuttles(events: DataFrame, frame: int = 24) -> DataFrame:
    """Zone-type changes among a track's last events. (W-08, ST-09's input)"""
    w = Window.partitionBy("store_id", "external_track_id").orderBy("occurred_at", "event_id")
    moved = F.coalesce((F.lag("zone_type").over(w) != F.col("zone_type")).cast("int"), F.lit(0))
    return events.where("zone_type is not null").withColumn("moved", moved).withColumn("recent", F.sum("moved").over(w.rowsBetween(-frame + 1, 0))).groupBy("store_id", "external_track_id").agg(F.sum("moved").cast("long").alias("transitions"), F.max("recent").cast("long").alias("most_recent"))


def shared_zone_types(emitted: str, after: str):
    """Whether two arrays of zone types meet. (U-06)"""
    return F.coalesce(F.arrays_overlap(emitted, after), F.lit(False))


def overlap_suppressed(events: DataFrame, seconds: int = 5) -> DataFrame:
    """Entries of a track on another camera within `seconds` after one: band semi-join. (J-16, ST-08 in batch)"""
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    width = seconds * 1_000_000
    e = events.where(F.col("event_type") == C.ENTERED).select("event_id", "store_id", "external_track_id", "camera_id", us("occurred_at").alias("at"))
    a = e.withColumn("slot", F.floor(F.col("at") / width))
    b = e.select(F.col("store_id").alias("s"), F.col("external_track_id").alias("t"), F.col("camera_id").alias("cam"), F.col("at").alias("before"), F.explode(F.array(F.floor(F.col("at") / width), F.floor(F.col("at") / width) + 1)).alias("slot2"))
    near = (F.col("store_id") == F.col("s")) & (F.col("external_track_id") == F.col("t")) & (F.col("slot") == F.col("slot2")) & (F.col("camera_id") != F.col("cam")) & (F.col("at") - F.col("before")).between(1, width)
    return a.join(b, near, "left_semi").select("event_id")
