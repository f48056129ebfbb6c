"""Sources and sinks: event JSON lines, till CSV, YAML configuration, idempotent writers."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

EVENT = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("event_id", "event_type", "schema_version", "tenant_id", "store_id", "occurred_at", "correlation_id", "causation_id", "idempotency_key")
    ]
    + [T.StructField("aggregate", T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.StringType())])), T.StructField("payload", T.StringType())]
)
#: Columns of the till export that are used; all are read as text and cast where they are needed.
POS_COLUMNS = (
    "order_id invoice_number invoice_type order_date order_time store_id customer_name customer_number sku product_name brand_name dep_name "
    "sub_category brand_type salesperson_name offer_name qty GMV NMV total_amount"
).split()


def read_events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One event a line; blank lines are skipped; payload stays JSON text. (S-01)"""
    return spark.read.schema(EVENT).json(path).where("event_type is not null")


def stream_events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The same files as a stream. (S-02 as a file drop)"""
    return spark.readStream.schema(EVENT).json(path)


def unwrap_batches(raw: DataFrame) -> DataFrame:
    """Bodies (value) that hold one event or {"events": [...]} -> one row an event, numbered in its body, with the event's own JSON (body) and the request's size. (S-02)"""
    many = F.from_json(F.get_json_object("value", "$.events"), "array<string>")
    bodies = F.coalesce(many, F.array("value"))
    x = raw.withColumn("request_id", F.monotonically_increasing_id()).withColumn("request_size", F.size(bodies)).select("request_id", "request_size", F.posexplode(bodies).alias("idx", "body"))
    return x.select("request_id", "request_size", "idx", "body", F.from_json("body", EVENT).alias("e")).select("request_id", "request_size", "idx", "body", "e.*")


def read_pos_csv(spark: SparkSession, path: str) -> DataFrame:
    """Till lines of a headed CSV, every column text, numbered in file order; columns of POS_COLUMNS that the file lacks are null. (S-03)"""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path).withColumn("line_no", F.monotonically_increasing_id())
    for name in POS_COLUMNS:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    return raw


# ------------------------------------------------------------ configuration, small and read by the driver
def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Nested maps merged, scalars and lists replaced. (F-26)"""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def env_overrides(prefix: str = "PIPELINE_", environ: dict[str, str] | None = None) -> dict[str, Any]:
    """PIPELINE_A__B=x -> {"a": {"b": "x"}}. (S-06)"""
    out: dict[str, Any] = {}
    for name, value in (environ if environ is not None else os.environ).items():
        if name.startswith(prefix):
            at = out
            *path, last = name[len(prefix) :].lower().split("__")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = value
    return out


def load_config(path: str) -> dict[str, Any]:
    """A map from a YAML file, or from JSON, which needs no package. (S-04..S-06)"""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def pipeline_config(path: str, defaults: dict[str, Any] | None = None, environ: dict[str, str] | None = None) -> dict[str, Any]:
    """Defaults, the file over them, the environment over both. (S-06)"""
    return deep_merge(deep_merge(defaults or {}, load_config(path)), env_overrides(environ=environ))


def zones_frame(spark: SparkSession, config: dict[str, list[dict[str, Any]]]) -> DataFrame:
    """Zones by camera as a small table of polygons and lines. (S-04)"""
    rows = [
        (cam, z["zone_id"], z.get("name"), z.get("zone_type"), z.get("kind", "polygon"), z.get("layout_zone_id"), [(float(x), float(y)) for x, y in z["points"]])
        for cam, zones in config.items() for z in zones
    ]
    return spark.createDataFrame(rows, "camera_id string, zone_id string, name string, zone_type string, kind string, layout_id string, points array<struct<x: double, y: double>>")


def layout_frames(spark: SparkSession, layout: dict[str, Any]) -> dict[str, DataFrame]:
    """A store's floor plan as small tables: zones with their section's label, zones of cameras and of types, brand bays. (S-05, P-13)"""
    sections = layout.get("sections", {})
    zones = [(z["id"], z["label"], z.get("section", "foh"), sections.get(z.get("section", "foh"), {}).get("label", z.get("section", "foh"))) for z in layout.get("layout_zones", [])]
    bays = [(k, i, str(b.get("brand", b) if isinstance(b, dict) else b)) for k, many in layout.get("brand_bays", {}).items() for i, b in enumerate(many)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "zones": make(zones, "layout_id string, label string, section string, section_label string"),
        "camera_zones": make(list(layout.get("camera_zone_mapping", {}).items()), "zone_id string, layout_id string"),
        "zone_types": make([(str(k).lower(), v) for k, v in layout.get("zone_type_mapping", {}).items()], "zone_type string, layout_id string"),
        "brand_bays": make(bays, "zone_id string, place int, brand string"),
    }


def video_key(name: Column | str) -> Column:
    """CAM 1.mp4, cam_1 and CAM1 alike. (S-17)"""
    x = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(F.substring_index(F.regexp_replace(x, r"\\\\", "/"), "/", -1), r"\.[^.]*$", "")
    return F.regexp_replace(F.lower(stem), r"[\s_\-.]+", "")


def match_videos(files: DataFrame, cameras: DataFrame) -> DataFrame:
    """files (path), as of a binaryFile listing, with the camera (camera_id, name, video) that each one is of; the first file of a camera is its target. (S-17)"""
    by = cameras.select("camera_id", F.explode(F.array_distinct(F.array(video_key("name"), video_key("video")))).alias("key"))
    x = files.select("path", video_key("path").alias("key")).join(F.broadcast(by), "key", "left")
    rn = F.row_number().over(Window.partitionBy(F.coalesce("camera_id", F.concat(F.lit("#"), "path"))).orderBy("path"))
    return x.withColumn("target", F.col("camera_id").isNotNull() & (rn == 1)).select("path", "camera_id", "target")


# ------------------------------------------------------------ listings
def page(df: DataFrame, order: list, offset: int = 0, limit: int = 500) -> DataFrame:
    """Paging with at most 500 rows. (S-07, S-18, T-03)"""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, 500)))


def between(df: DataFrame, at: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from `start` to `end`, both included; either may be missing."""
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    df = df.where(F.col(at) >= t(start)) if start else df
    return df.where(F.col(at) <= t(end)) if end else df


def list_sessions(sessions: DataFrame, store_id: str, status: str | None = None, start: str | None = None, end: str | None = None, offset: int = 0, limit: int = 500) -> DataFrame:
    """Latest first. (S-12)"""
    s = between(sessions.where(F.col("store_id") == store_id), "started_at", start, end)
    return page(s.where(F.col("status") == status) if status else s, [F.desc("started_at"), "external_track_id"], offset, limit)


def list_transactions(tx: DataFrame, store_id: str, start: str | None = None, end: str | None = None, offset: int = 0, limit: int = 500) -> DataFrame:
    """Latest first. (S-13)"""
    return page(between(tx.where(F.col("store_id") == store_id), "occurred_at", start, end), [F.desc("occurred_at"), "transaction_id"], offset, limit)


def list_anomalies(anomalies: DataFrame, store_id: str, severity: str | None = None, unresolved_only: bool = False, start: str | None = None, end: str | None = None, offset: int = 0, limit: int = 500) -> DataFrame:
    """Latest first. (S-14)"""
    a = between(anomalies.where(F.col("store_id") == store_id), "detected_at", start, end)
    a = a.where(F.col("severity") == severity) if severity else a
    return page(a.where("resolved_at is null") if unresolved_only else a, [F.desc("detected_at"), "anomaly_id"], offset, limit)


def list_metrics(stored: DataFrame, store_id: str, metric: str, start: str, end: str, granularity: str | None = None) -> DataFrame:
    """Buckets that begin and end in the period, in order: the bucket that runs isn't seen. (S-15, S-16)"""
    m = stored.where((F.col("store_id") == store_id) & (F.col("metric_name") == metric))
    m = m.where(F.col("granularity") == granularity) if granularity else m
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return m.where((F.col("bucket_start") >= t(start)) & (F.col("bucket_end") <= t(end))).orderBy("bucket_start")


def active_session(sessions: DataFrame, store_id: str, track: str) -> DataFrame:
    """(S-21)"""
    return sessions.where((F.col("store_id") == store_id) & (F.col("external_track_id") == track) & (F.col("status") == "active")).limit(1)


def by_id(df: DataFrame, column: str, value: Any) -> DataFrame:
    """(S-18)"""
    return df.where(F.col(column) == value).limit(1)


# ------------------------------------------------------------ writers
def split_new_events(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """batch (idx, event_id, idempotency_key) with outcome created, duplicate_id or duplicate_key. (K-01, J-10, S-20)

    A row is a duplicate of what is stored, or of an earlier row of the batch. Rows without an
    id or key are keyed by idx, so they don't meet in one task.
    """
    own = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.concat(F.lit("#"), F.col("idx").cast("string")))
    by = lambda c: Window.partitionBy(own(c)).orderBy("idx")
    ids = stored.select(F.col("event_id").alias("known_id")).where("known_id is not null").distinct()
    keys = stored.select(F.col("idempotency_key").alias("known_key")).where("known_key is not null").distinct()
    x = batch.join(ids, F.col("event_id") == F.col("known_id"), "left").join(keys, F.col("idempotency_key") == F.col("known_key"), "left")
    x = x.withColumn("id_no", F.row_number().over(by("event_id"))).withColumn("key_no", F.row_number().over(by("idempotency_key")))
    outcome = (
        F.when(F.col("known_id").isNotNull() | (F.col("event_id").isNotNull() & (F.col("id_no") > 1)), "duplicate_id")
        .when(F.col("known_key").isNotNull() | (F.col("idempotency_key").isNotNull() & (F.col("key_no") > 1)), "duplicate_key")
        .otherwise("created")
    )
    return x.withColumn("outcome", outcome).drop("known_id", "known_key", "id_no", "key_no")


def new_transactions(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of batch (store_id, external_ref, load_no, ...) that are not stored, the first of each reference; ones without a reference are all new. (K-02)"""
    key = ["store_id", "external_ref"]
    named = batch.where("external_ref is not null").join(stored.select(*key), key, "left_anti")
    first = named.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("load_no"))).where("rn = 1").drop("rn")
    return first.unionByName(batch.where("external_ref is null"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored ones of equal keys; among new ones the last loaded (load_no) wins. (K-03)"""
    both = stored.withColumn("load_no", F.lit(-1).cast("long")).unionByName(new)
    return both.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("load_no")))).where("rn = 1").drop("rn", "load_no")


def append(df: DataFrame, path: str) -> None:
    """Sessions and domain events are only ever added. (K-06, K-10)"""
    df.write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str, at: str = "occurred_at") -> None:
    """JSON lines in time order within files, times as ISO 8601 in UTC. (K-04)"""
    stamps = [f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz")]
    out = df.sortWithinPartitions(at)
    for name in stamps:
        out = out.withColumn(name, C.iso_utc(name))
    out.write.mode("overwrite").json(path)


def exported(events: DataFrame, store_id: str, drop_mock: bool = False) -> DataFrame:
    """Vision events of a store as events to ingest again, their payload with the video's base name. (K-11, inverse of S-01)"""
    e = events.where((F.col("store_id") == store_id) & F.col("event_type").startswith("vision."))
    e = e.where(F.coalesce("detector_mode", F.lit("")) != "mock") if drop_mock else e
    inner = [c for c in ("zone_id", "zone_type", "camera_id", "external_track_id", "class_label", "dwell_ms", "detector_mode", "frame_index") if c in e.columns]
    payload = F.to_json(F.struct("store_id", *inner, C.video_name("source_video").alias("source_video")))
    key = F.concat_ws("-", "event_type", "external_track_id", "zone_id", F.unix_millis(F.col("occurred_at").cast("timestamp")).cast("string"))
    return e.select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.lit("1.0.0").alias("schema_version"), "store_id", "occurred_at", key.alias("idempotency_key"), payload.alias("payload"))


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions that df holds. (K-07)"""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def batch_numbers(df: DataFrame, order: str, size: int = 500) -> DataFrame:
    """Rows in batches of `size` (1 to 500) by `order`. (K-05)

    Within ranges of `order` the number is local; the range keeps it unique, so no task sees all rows.
    """
    size = max(1, min(500, size))
    ranged = df.repartitionByRange(order).withColumn("range_no", F.spark_partition_id())
    rn = F.row_number().over(Window.partitionBy("range_no").orderBy(order))
    return ranged.withColumn("batch_no", F.floor((rn - 1) / size)).withColumn("batch_id", F.concat_ws("-", "range_no", "batch_no")).drop("range_no", "batch_no")
