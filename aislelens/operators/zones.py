"""Heatmap and rule-based anomalies."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


# ------------------------------------------------------------ layout
def remap_zones(events: DataFrame, camera_zones: DataFrame, zone_types: DataFrame) -> DataFrame:
    """layout_id of each event: of its camera zone (zone_id), else of its zone type, where null says unmapped. (P-12)

    Both are small tables: camera_zones (zone_id, layout_id), zone_types (zone_type, layout_id).
    """
    a = F.broadcast(camera_zones.select("zone_id", F.col("layout_id").alias("by_camera")))
    b = F.broadcast(zone_types.select(F.lower("zone_type").alias("kind"), F.col("layout_id").alias("by_type")))
    x = events.join(a, "zone_id", "left").join(b, F.lower("zone_type") == F.col("kind"), "left")
    return x.withColumn("layout_id", F.coalesce("by_camera", "by_type")).drop("by_camera", "by_type", "kind")


def layout_keys(events: DataFrame, zones: DataFrame) -> DataFrame:
    """events with layout_id -> zone_key, zone_label and section of the layout's zone (layout_id, label, section_label), else their own. (P-12, P-13)"""
    z = F.broadcast(zones.select("layout_id", F.col("label").alias("layout_label"), "section_label"))
    x = events.join(z, "layout_id", "left")
    known = F.col("layout_label").isNotNull()
    own = F.coalesce(F.nullif(F.col("zone_name"), F.lit("")) if "zone_name" in events.columns else F.lit(None), F.nullif("zone_type", F.lit("")), "zone_id")
    return x.withColumn("zone_key", F.when(known, F.concat(F.lit("layout:"), "layout_id")).otherwise(C.zone_key())).withColumn("zone_label", F.coalesce("layout_label", own)).drop("layout_label")


def zone_catalogue(camera_zones: DataFrame, mapping: DataFrame, generic: DataFrame, layout: DataFrame, events: DataFrame) -> DataFrame:
    """Camera zones (camera_id, zone_id, name, layout_id) with their layout zone: given, else of the mapping (zone_id), else of the generic name, and whether events name them. (A-67)"""
    m, g = F.broadcast(mapping.select("zone_id", F.col("layout_id").alias("m"))), F.broadcast(generic.select("name", F.col("layout_id").alias("g")))
    seen = events.where(F.col("event_type").isin(C.ENTERED, C.EXITED)).select("zone_id").where("zone_id <> ''").distinct().withColumn("in_db", F.lit(True))
    x = camera_zones.join(m, "zone_id", "left").join(g, "name", "left").withColumn("layout_id", F.coalesce(F.nullif("layout_id", F.lit("")), "m", "g"))
    x = x.join(F.broadcast(layout.select("layout_id", "label")), "layout_id", "left").join(seen, "zone_id", "left")
    return x.select("camera_id", "zone_id", "layout_id", F.coalesce("label", "name").alias("store_name"), F.coalesce("in_db", F.lit(False)).alias("in_db"))


# ------------------------------------------------------------ heatmap
def heatmap(events: DataFrame, medium: int = 3, high: int = 5) -> DataFrame:
    """Visits, dwell, their min-max norms and confidence by zone, with the zone's first label. (A-24, P-10, P-11, W-03)

    events may have zone_key and zone_label from a layout. An exit without a dwell is no visit.
    """
    kind = F.col("event_type")
    e = events if "dwell_seconds" in events.columns else events.withColumn("dwell_seconds", F.lit(None).cast("double"))
    e = e if "zone_key" in events.columns else e.withColumn("zone_key", C.zone_key())
    if "zone_label" not in events.columns:
        named = F.nullif(F.col("zone_name"), F.lit("")) if "zone_name" in events.columns else F.lit(None).cast("string")
        e = e.withColumn("zone_label", F.coalesce(named, F.nullif("zone_type", F.lit("")), "zone_id"))
    e = e.withColumn("dwell", F.when(kind == C.EXITED, C.dwell_seconds()))
    e = e.where(((kind == C.ENTERED) | ((kind == C.EXITED) & F.col("dwell").isNotNull())) & C.is_customer_event() & F.col("zone_key").isNotNull())
    good = F.when(F.col("dwell") >= 0, F.col("dwell"))
    z = e.groupBy("store_id", "zone_key").agg(
        F.count_if(kind == C.ENTERED).alias("visits"), F.avg(good).alias("avg_dwell"), F.count(good).alias("samples"), F.min_by("zone_label", F.struct("occurred_at", "zone_label")).alias("zone_label")
    )
    w = Window.partitionBy("store_id")  # a store's zones, not its events

    def norm(x: str) -> Column:
        lo, hi, v = F.min(x).over(w), F.max(x).over(w), F.col(x)
        return F.when(hi <= lo, F.when(v > 0, 1.0).otherwise(0.0)).otherwise((v - lo) / (hi - lo))

    share = F.col("samples") / F.nullif("visits", F.lit(0))
    conf = F.when(F.col("visits") < medium, "LOW").when((F.col("visits") >= high) & (share >= 0.5), "HIGH").when(F.col("samples") == 0, "LOW").otherwise("MEDIUM")
    return z.select(
        "store_id", "zone_key", "zone_label", "visits", "samples", F.round("avg_dwell", 2).alias("avg_dwell"), F.round(norm("visits"), 4).alias("visit_norm"),
        F.round(F.when(F.col("samples") == 0, 0.0).otherwise(norm("avg_dwell")), 4).alias("dwell_norm"), conf.alias("confidence"),
    )


def zone_order() -> list[Column]:
    """Most visited zones first, ties by key. (T-06)"""
    return [F.desc("visits"), F.asc("zone_key")]


def heatmap_confidence(h: DataFrame) -> DataFrame:
    """The lowest level of a store's zones, their visits, and its weighted dwell. (A-25, A-38)"""
    has = lambda x: F.max((F.col("confidence") == x).cast("int")) == 1
    return h.groupBy("store_id").agg(
        F.when(has("LOW"), "LOW").when(has("MEDIUM"), "MEDIUM").otherwise("HIGH").alias("confidence"), F.count("*").alias("zones"), F.sum("visits").alias("zone_visits"),
        F.round(F.sum(F.col("avg_dwell") * F.col("samples")) / F.nullif(F.sum("samples"), F.lit(0)), 6).alias("weighted_dwell"),
    )


def zone_counts(events: DataFrame, start: str, middle: str, end: str) -> DataFrame:
    """Entries by zone in [start, middle) and [middle, end], with the zone's first label, from one scan. (A-26, R-05, J-09)"""
    t = F.col("occurred_at")
    e = events.where((F.col("event_type") == C.ENTERED) & C.is_customer_event() & C.in_period("occurred_at", start, end)).withColumn("zone_key", C.zone_key()).where("zone_key is not null")
    label = F.coalesce(F.nullif("zone_type", F.lit("")), "zone_id")
    now = t >= F.lit(middle).cast("timestamp_ntz")
    return e.groupBy("store_id", "zone_key").agg(F.count_if(now).alias("current"), F.count_if(~now).alias("baseline"), F.min_by(label, F.struct("occurred_at", label)).alias("zone_label"))


# ------------------------------------------------------------ rules
@dataclass(frozen=True)
class Thresholds:
    """Limits of the rules; a store's own replace them. (R-06)"""

    queue_spike_ratio_warn: float = 1.5
    queue_spike_ratio_critical: float = 2.5
    queue_spike_min_baseline_visits: int = 5
    conversion_drop_pp_warn: float = 0.15
    conversion_drop_pp_critical: float = 0.30
    conversion_min_entry: int = 10
    dead_zone_ratio: float = 0.05
    dead_zone_min_store_visits: int = 20
    dead_zone_min_zones: int = 2
    stale_feed_warn_minutes: int = 15
    stale_feed_critical_minutes: int = 60
    queue_zone_keys: tuple[str, ...] = tuple([f"type:{z}" for z in C.QUEUE_ZONES] + list(C.QUEUE_ZONES))


def thresholds(config: dict[str, Any] | None) -> Thresholds:
    """From a store's config, {"anomalies": {...}}; names that are no limit are left out. (R-06)"""
    own = (config or {}).get("anomalies", {})
    got = {f.name: type(f.default)(own[f.name]) for f in fields(Thresholds) if f.name != "queue_zone_keys" and f.name in own}
    keys = own.get("queue_zone_keys")
    return Thresholds(**got, **({"queue_zone_keys": tuple(str(k).lower() for k in keys)} if keys else {}))


def _found(df: DataFrame, kind: str, scope: Column | str, severity: Column, measure: Column, message: Column) -> DataFrame:
    return df.select("store_id", C.c(scope).alias("zone_key"), F.lit(kind).alias("anomaly_type"), severity.alias("severity"), F.round(measure, 6).alias("measure"), message.alias("message"))


def queue_spikes(counts: DataFrame, limit: Thresholds = Thresholds()) -> DataFrame:
    """Queue zones with far more entries than before. A key or its part behind the first colon has to be a queue's. (R-01, R-09, P-15)"""
    ours = F.col("zone_key").isin(*limit.queue_zone_keys) | F.regexp_replace("zone_key", "^[^:]*:", "").isin(*limit.queue_zone_keys)
    now, before = F.col("current"), F.col("baseline")
    r = now / F.nullif(before, F.lit(0))
    hit = counts.where(ours & (before >= limit.queue_spike_min_baseline_visits) & (now > before) & (r >= limit.queue_spike_ratio_warn))
    text = F.format_string("Queue spike in %s: %d visits vs baseline %d (%.1fx).", "zone_label", now, before, r)
    return _found(hit, "QUEUE_SPIKE", "zone_key", F.when(r >= limit.queue_spike_ratio_critical, "CRITICAL").otherwise("WARN"), r, text)


def dead_zones(counts: DataFrame, limit: Thresholds = Thresholds()) -> DataFrame:
    """Zones with hardly a visit beside the store's busiest one; zones without any entry in the window aren't known. (R-03, R-09, W-04)"""
    w = Window.partitionBy("store_id")  # a store's zones
    z = counts.where("current > 0").withColumn("peak", F.max("current").over(w)).withColumn("total", F.sum("current").over(w)).withColumn("zones", F.count("*").over(w))
    share = F.col("current") / F.col("total")
    hit = z.where((F.col("zones") >= limit.dead_zone_min_zones) & (F.col("total") >= limit.dead_zone_min_store_visits) & (F.col("current") <= limit.dead_zone_ratio * F.col("peak")))
    text = F.concat(F.format_string("Dead zone detected: %s had only %d visits (", "zone_label", "current"), C.percent(share), F.format_string(" of store traffic, peak zone %d).", "peak"))
    return _found(hit, "DEAD_ZONE", "zone_key", F.when(share < limit.dead_zone_ratio / 2, "WARN").otherwise("INFO"), share, text)


def conversion_drops(current: DataFrame, baseline: DataFrame, limit: Thresholds = Thresholds()) -> DataFrame:
    """From (store_id, entries, purchases, rate) twice. (R-02, R-09)"""
    b = baseline.select("store_id", F.col("rate").alias("base"))
    d = F.col("base") - F.col("rate")
    hit = current.join(b, "store_id").where((F.col("entries") >= limit.conversion_min_entry) & (d >= limit.conversion_drop_pp_warn))
    text = F.concat(
        F.lit("Conversion dropped "), C.percent(d, 0), F.lit(" (baseline "), C.percent("base", 0), F.lit(" → current "), C.percent("rate", 0), F.format_string(", %d/%d purchases).", "purchases", "entries")
    )
    return _found(hit, "CONVERSION_DROP", F.lit("global"), F.when(d >= limit.conversion_drop_pp_critical, "CRITICAL").otherwise("WARN"), d, text)


def stale_feeds(feed: DataFrame, limit: Thresholds = Thresholds()) -> DataFrame:
    """From (store_id, age_minutes). (R-04, R-09)"""
    a = F.col("age_minutes")
    hit = feed.where(a.isNull() | (a >= limit.stale_feed_warn_minutes))
    text = F.when(a.isNull(), "No vision feed events recorded for this store.").otherwise(F.format_string("Vision feed stale: last event %.0f minutes ago.", a.cast("double")))
    return _found(hit, "STALE_FEED", F.when(a.isNull(), "none").otherwise("feed"), F.when(a.isNull() | (a >= limit.stale_feed_critical_minutes), "CRITICAL").otherwise("WARN"), a, text)


def anomaly_ids(a: DataFrame, namespace: str, period_end: str) -> DataFrame:
    """detected_at, and an id of store, type, scope and the period's last hour. (R-07)"""
    at = F.lit(period_end).cast("timestamp_ntz")
    hour = F.date_format(F.date_trunc("hour", at).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return a.withColumn("detected_at", at).withColumn("anomaly_id", C.uuid5(namespace, F.concat_ws(":", "store_id", "anomaly_type", "zone_key", hour)))


def merge_anomalies(computed: DataFrame, persisted: DataFrame) -> DataFrame:
    """Stored anomalies whose type was not computed anew join the computed ones. (R-08, J-11)

    Both (store_id, zone_key, anomaly_type, severity, measure, message, detected_at, anomaly_id).
    """
    have = computed.select("store_id", F.col("anomaly_type").alias("t")).distinct()
    old = persisted.withColumn("anomaly_type", F.upper("anomaly_type")).withColumn("severity", C.severity("severity"))
    rest = old.join(have.withColumnRenamed("store_id", "s"), (F.col("store_id") == F.col("s")) & (F.col("anomaly_type") == F.col("t")), "left_anti")
    return computed.withColumn("source", F.lit("computed")).unionByName(rest.withColumn("source", F.lit("persisted")))


def anomaly_order() -> list[Column]:
    """By severity, then by time. (R-08, T-09)"""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARN", 1).when(F.col("severity") == "INFO", 2).otherwise(99)
    return [rank, F.asc("detected_at"), F.asc("anomaly_type"), F.asc("store_id"), F.asc("zone_key")]


def resolve_anomalies(stored: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Open anomalies among ids (anomaly_id) get their resolved_at. (K-08)"""
    hit = ids.select("anomaly_id").distinct().withColumn("hit", F.lit(True))
    done = F.when(F.col("hit") & F.col("resolved_at").isNull(), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("resolved_at"))
    return stored.join(hit, "anomaly_id", "left").withColumn("resolved_at", done).select(*stored.columns)
