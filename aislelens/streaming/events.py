"""Events to ingest: frames, ends of tracks, and zone events, with keys and ids that a rerun gives again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

_URL = str(uuid.NAMESPACE_URL)


def who() -> Column:
    return F.concat_ws(":", "store_id", "global_id")


def session_uuid() -> Column:
    """Id of a person's numbered session; null without one."""
    return F.when(F.col("session_no").isNotNull(), C.uuid5(_URL, F.concat_ws(":", F.lit("session"), "store_id", "global_id", F.col("session_no").cast("string"))))


def class_label() -> Column:
    return F.when(F.col("is_staff"), "staff").otherwise("visitor")


def enveloped(df: DataFrame, kind: Column, at: str, key: Column, aggregate: tuple[str, Column], payload: list, tenant_id: str, correlation_id: str) -> DataFrame:
    """Rows as events: `payload` columns as JSON (nulls are left out), the id from the key."""
    return df.select(
        C.uuid5(_URL, key).alias("event_id"), kind.alias("event_type"), F.lit("1.0.0").alias("schema_version"), F.lit(tenant_id).alias("tenant_id"), "store_id", C.iso_utc(at).alias("occurred_at"),
        F.lit(correlation_id).alias("correlation_id"), key.alias("idempotency_key"), F.struct(F.lit(aggregate[0]).alias("type"), aggregate[1].alias("id")).alias("aggregate"), F.to_json(F.struct(*payload, "store_id")).alias("payload"),
    )


def zone_events(persons: DataFrame, tenant_id: str, correlation_id: str, detector_mode: str = "yolo", names: dict[str, str] | None = None) -> DataFrame:
    """What person_events() lets pass, with the position and session where they are known. names: of zones. (ST-15, P-21, P-22)"""
    e = persons.where(F.col("kind").isin("enter", "exit") & ~F.col("suppressed") & C.emitted("zone_type", "is_staff"))
    kind = F.when(F.col("kind") == "enter", C.ENTERED).otherwise(C.EXITED)
    key = F.concat_ws("-", kind, who(), "zone_id", F.unix_millis("ts").cast("string"))
    flag = lambda x: F.when(x, F.lit(True))
    spot = F.when(F.col("foot_x").isNotNull(), F.struct(F.col("foot_x").alias("x"), F.col("foot_y").alias("y"), F.lit("normalized").alias("space"))) if "foot_x" in persons.columns else F.lit(None).cast("struct<x: double>")
    payload = [
        "zone_id", (C.lookup(names, F.col("zone_id")) if names else F.lit(None).cast("string")).alias("zone_name"), "zone_type", "camera_id", who().alias("external_track_id"), class_label().alias("class_label"), spot.alias("position"),
        session_uuid().alias("session_id"), "direction", "dwell_ms", flag(F.col("is_reentry")).alias("is_reentry"), flag(F.col("is_store_exit")).alias("is_store_exit"), flag(C.store_entry("direction", "zone_type")).alias("is_store_entry"),
        F.lit(detector_mode).alias("detector_mode"),
    ]
    return enveloped(e, kind, "ts", key, ("zone", C.uuid5(_URL, F.col("zone_id"))), payload, tenant_id, correlation_id)


def track_ended_events(runs: DataFrame, tenant_id: str, correlation_id: str, detector_mode: str = "yolo") -> DataFrame:
    """The end of each segment that has a global_id: runs (store_id, camera_id, local_track_id, run, began, left, global_id, is_staff, perhaps session_no). (ST-15)

    A local track that comes back after a gap is another segment, so the segment's number is
    part of the key from the second one on.
    """
    again = F.when(F.col("run") > 1, F.col("run").cast("string"))
    key = F.concat_ws("-", F.lit("track-ended"), who(), "camera_id", F.col("local_track_id").cast("string"), again)
    session = session_uuid() if "session_no" in runs.columns else F.lit(None).cast("string")
    payload = ["camera_id", who().alias("external_track_id"), "local_track_id", C.iso_utc("began").alias("first_seen"), C.iso_utc("left").alias("last_seen"), class_label().alias("class_label"), session.alias("session_id"), F.lit(detector_mode).alias("detector_mode")]
    return enveloped(runs, F.lit(C.ENDED), "left", key, ("track", C.uuid5(_URL, who())), payload, tenant_id, correlation_id)


def frame_events(frames: DataFrame, run_id: str, tenant_id: str, correlation_id: str, every: int = 30, detector_mode: str = "yolo") -> DataFrame:
    """Every n-th frame of a camera with its people: frames (store_id, camera_id, frame_index, ts, local_track_id, global_id, confidence, is_staff, perhaps bbox). (ST-14, ST-15)

    Frames are numbered over all time ranges; a frame's people, who are few, are one list.
    """
    from .jobs import emitted_frames

    place = ["store_id", "camera_id", "frame_index"]
    kept = frames.join(emitted_frames(frames.groupBy(*place).agg(F.min("ts").alias("ts")), every).select(*place), place)
    local = F.col("local_track_id").cast("string")
    found = C.uuid5(_URL, F.concat_ws("-", F.lit("detection"), "store_id", "camera_id", F.col("frame_index").cast("string"), local, F.lit(run_id)))
    box = [F.col("bbox")] if "bbox" in frames.columns else []
    person = F.struct(F.col("local_track_id"), who().alias("external_track_id"), found.alias("detection_id"), class_label().alias("label"), F.round("confidence", 6).alias("confidence"), *box)
    one = kept.groupBy(*place).agg(F.min("ts").alias("ts"), F.array_sort(F.collect_list(person)).alias("people"))
    seen = lambda p: F.struct(p["detection_id"].alias("detection_id"), p["label"].alias("class_external_id"), *([p["bbox"].alias("bbox")] if box else []), p["confidence"].alias("confidence"))
    track = lambda p: F.struct(p["local_track_id"].alias("track_id_ext"), p["detection_id"].alias("detection_id"), F.lit("active").alias("state"), p["external_track_id"].alias("external_track_id"))
    one = one.withColumn("detections", F.transform("people", seen)).withColumn("tracks", F.transform("people", track))
    key = F.concat_ws("-", F.lit("frame"), "camera_id", F.col("frame_index").cast("string"), F.lit(run_id))
    payload = [F.lit(run_id).alias("pipeline_run_id"), "camera_id", "frame_index", C.iso_utc("ts").alias("frame_timestamp"), "detections", "tracks", F.lit(detector_mode).alias("detector_mode")]
    return enveloped(one, F.lit(C.FRAME), "ts", key, ("pipeline_run", F.lit(run_id)), payload, tenant_id, correlation_id)
