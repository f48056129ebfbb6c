"""Time series and KPI counts over typed events, sessions and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .ingest import parsed, payload_items
from .ranks import percentiles


def _per_hour(df: DataFrame, ts: str = "occurred_at", value=None) -> DataFrame:
    value = F.count("*").cast("double") if value is None else value
    return df.groupBy("store_id", C.hour(ts).alias("bucket_start")).agg(value.alias("value"), F.count("*").alias("sample_count"))


def footfall(events: DataFrame) -> DataFrame:
    """Customer zone entries an hour. (A-01)"""
    return _per_hour(events.where((F.col("event_type") == C.ENTERED) & C.is_customer_event()))


def visitors(events: DataFrame) -> DataFrame:
    """Distinct customer tracks an hour, any vision event. (A-02)"""
    return _per_hour(events.where(F.col("event_type").startswith("vision.") & C.is_customer_track()), value=F.countDistinct("external_track_id").cast("double"))


def queue_enters(events: DataFrame) -> DataFrame:
    """(A-03)"""
    return _per_hour(events.where((F.col("event_type") == C.ENTERED) & C.is_customer_event() & C.is_queue()))


def revenue(tx: DataFrame) -> DataFrame:
    """(A-04)"""
    return _per_hour(tx.where("status = 'completed'"), value=F.sum("amount").cast("double"))


def purchases(tx: DataFrame) -> DataFrame:
    """(A-05)"""
    return _per_hour(tx.where("status = 'completed'"))


def rollup(series: DataFrame, name: str) -> DataFrame:
    """Series as store_metrics rows. (A-37, K-03's input)"""
    return series.select(
        "store_id", F.lit(name).alias("metric_name"), "bucket_start", (F.col("bucket_start") + F.expr("interval 1 hour")).alias("bucket_end"), F.lit("hour").alias("granularity"), "value", "sample_count"
    )


def resolve(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored buckets where there are any for a store and metric, live ones else."""
    have = stored.select("store_id", "metric_name").distinct()
    return stored.unionByName(live.join(have, ["store_id", "metric_name"], "left_anti"))


def _flag(events: DataFrame, name: str):
    return F.coalesce(F.col(name), F.lit(False)) if name in events.columns else F.lit(False)


def track_counts(events: DataFrame) -> DataFrame:
    """What every KPI of a store needs, a row a track: counts merge here, and distinct tracks are rows. Events without a track are one row a store."""
    kind, cust = F.col("event_type"), C.is_customer_event()
    entered, exited = kind == C.ENTERED, kind == C.EXITED
    door = F.lower(F.coalesce("zone_type", F.lit(""))).isin(*C.ENTRY_ZONES)
    human = F.lower(F.coalesce("class_label", F.lit(""))) != "staff"
    track = F.coalesce("external_track_id", F.lit(""))
    n = lambda x, name: F.count_if(x).alias(name)
    return events.groupBy("store_id", F.when((track != "") & (F.lower(track) != "null"), track).alias("track")).agg(
        n((entered | exited) & cust, "zone_events"), n(entered & _flag(events, "is_store_entry"), "entries_flagged"), n(entered & human & door, "door_events"), n(entered & cust, "entered"),
        n((entered | exited) & _flag(events, "is_store_exit"), "exits_flagged"), n((kind == C.ENDED) & human, "ended"), n(entered & _flag(events, "is_reentry"), "reentries"),
        n(kind.isin(C.ENTERED, C.EXITED, C.FRAME) & ~cust, "staff_events"), n(kind.startswith("vision."), "events"), n(entered & cust & C.is_queue(), "queue_enters"),
        F.max(F.when(kind.isin(C.ENTERED, C.EXITED, C.FRAME), F.col("occurred_at"))).alias("last_event"),
    )


def event_kpis(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """All event counts of a store from one pass by track. (A-06, A-09..A-12, A-14, A-19, A-20, A-44, A-60)

    store_entries: entries with the flag, staff or not; without any, tracks that entered by a
    door; without any, tracks that entered anywhere. store_exits: zone events with the flag,
    without any, ended tracks. sessions: staff ones among them count into staff_filtered.
    """
    has = lambda x: F.count_if(F.col("track").isNotNull() & (F.col(x) > 0))
    got = track_counts(events).groupBy("store_id").agg(
        has("zone_events").alias("visitors"), F.sum("entries_flagged").alias("flagged"), has("door_events").alias("by_zone"), has("entered").alias("by_track"),
        F.sum("exits_flagged").alias("exits_flagged"), has("ended").alias("exits_ended"), F.sum("reentries").alias("reentries"), F.sum("staff_events").alias("staff_events"),
        F.sum("events").alias("events"), F.max("last_event").alias("last_event"), F.sum("queue_enters").alias("queue_enters"),
    )
    staff = F.col("staff_events")
    if sessions is not None:
        got = got.join(sessions.groupBy("store_id").agg(F.count_if("staff").alias("staff_sessions")), "store_id", "left")
        staff = staff + F.coalesce("staff_sessions", F.lit(0))
    return got.select(
        "store_id", "visitors",
        F.when(F.col("flagged") > 0, F.col("flagged")).when(F.col("by_zone") > 0, F.col("by_zone")).otherwise(F.col("by_track")).alias("store_entries"),
        F.when(F.col("exits_flagged") > 0, F.col("exits_flagged")).otherwise(F.col("exits_ended")).alias("store_exits"),
        "reentries", staff.alias("staff_filtered"), "events", "last_event", "queue_enters",
    )


def session_kpis(sessions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sessions that started in the period, and exits of those that ended in it. (A-07, A-08, A-45, A-62)"""
    began = C.in_period("started_at", start, end) if start else F.lit(True)
    left = F.col("ended_at").isNotNull() & (C.in_period("ended_at", start, end) if start else F.lit(True))
    people, track = ~F.coalesce("staff", F.lit(False)), F.col("external_track_id")
    one = sessions.groupBy("store_id", "external_track_id").agg(
        F.count_if(began).alias("all"), F.count_if(began & people).alias("customers"), F.count_if(left & people).alias("exits")
    )
    return one.groupBy("store_id").agg(
        F.sum("all").alias("sessions"), F.sum("customers").alias("customer_sessions"), F.sum("exits").alias("session_exits"), F.count_if(track.isNotNull() & (F.col("customers") > 0)).alias("session_visitors")
    )


def sales_kpis(tx: DataFrame) -> DataFrame:
    """(A-13, A-15, A-16)"""
    done = F.col("status") == "completed"
    return tx.groupBy("store_id").agg(
        F.coalesce(F.sum(F.when(done, F.col("amount"))), F.lit(0)).cast("double").alias("revenue"),
        F.count_if(done).alias("purchases"),
        F.count_if(done & F.col("external_track_id").isNotNull()).alias("linked_purchases"),
    )


def coverage_by_camera(events: DataFrame) -> DataFrame:
    """(A-21, A-50, A-51, U-05) Distinct videos and modes are small sets a camera and merge before the exchange."""
    e, flag = F.col("event_type"), lambda x: F.count_if(_flag(events, x))
    modes = F.collect_set(F.nullif("detector_mode", F.lit("")))
    return events.groupBy("camera_id").agg(
        F.count("*").alias("events"),
        F.size(F.collect_set(C.video_name("source_video"))).cast("long").alias("videos"),
        (F.max("frame_index") + 1).cast("long").alias("frame_ceiling"),
        F.count_if(e == C.FRAME).alias("frames"),
        F.count_if(e.isin(C.ENTERED, C.EXITED, C.ENDED)).alias("detections"),
        flag("is_store_entry").alias("entries"), flag("is_store_exit").alias("exits"), flag("is_reentry").alias("reentries"),
        F.count_if((e == C.ENTERED) & F.col("zone_type").isin("billing_queue", "checkout")).alias("queue_events"),
        F.when(F.size(modes) > 1, "mixed").otherwise(F.try_element_at(modes, F.lit(1))).alias("detector_mode"),
    )


def coverage(events: DataFrame, start: str, end: str, labels: dict[str, str]) -> DataFrame:
    """Coverage of each store in a period: events inside and outside, cameras, videos named or told by the camera, frames, mode, lineage. (A-21, A-22, U-05, U-08, J-14)"""
    inside = C.in_period("occurred_at", start, end)
    cam = events.groupBy("store_id", "camera_id").agg(
        F.count_if(inside).alias("n"), F.count("*").alias("n_all"), F.collect_set(F.when(inside, C.video_name("source_video"))).alias("videos"),
        F.max(F.when(inside, F.col("frame_index"))).alias("top"), F.collect_set(F.when(inside, F.nullif("detector_mode", F.lit("")))).alias("modes"),
    )
    told = F.when(F.col("camera_id").isNotNull() & (F.col("n") > 0), F.coalesce(C.lookup(labels, F.col("camera_id")), F.col("camera_id")))
    cam = cam.withColumn("videos", F.array_union("videos", F.array_compact(F.array(C.video_name(told)))))
    got = cam.groupBy("store_id").agg(
        F.sum("n").alias("in_period"), F.sum("n_all").alias("all_time"), F.count_if((F.col("n") > 0) & F.col("camera_id").isNotNull()).alias("cameras"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("videos")))).alias("videos"), F.sum(F.col("top") + 1).cast("long").alias("frame_ceiling"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("modes")))).alias("modes"),
    )
    mode = F.when(F.size("modes") == 1, F.col("modes")[0]).when(F.size("modes") > 1, "mixed")
    lineage = F.when(mode == "mock", "mock_trajectory_pipeline").when(mode == "yolo", "yolo_cctv_pipeline").when(F.col("in_period") > 0, "ingested_events_missing_detector_mode")
    return got.select(
        "store_id", "in_period", (F.col("all_time") - F.col("in_period")).alias("outside"), "cameras", F.array_join("videos", ",").alias("videos"), F.size("videos").alias("n_videos"), "frame_ceiling", mode.alias("detector_mode"), lineage.alias("lineage")
    )


def zone_breakdown(events: DataFrame) -> DataFrame:
    """Customer entries and distinct tracks by zone type. (A-46)"""
    e = events.where((F.col("event_type") == C.ENTERED) & C.is_customer_event())
    one = e.groupBy("zone_type", "external_track_id").count()
    return one.groupBy("zone_type").agg(F.sum("count").alias("events"), F.count("external_track_id").alias("tracks"))


def type_counts(events: DataFrame) -> DataFrame:
    """Events by type with their distinct tracks, all and not staff. (A-42, A-63)"""
    one = events.groupBy("event_type", F.nullif("external_track_id", F.lit("")).alias("track")).agg(F.count("*").alias("n"), F.count_if(F.col("class_label") != "staff").alias("customers"))
    return one.groupBy("event_type").agg(F.sum("n").alias("events"), F.count("track").alias("tracks"), F.count_if(F.col("track").isNotNull() & (F.col("customers") > 0)).alias("customer_tracks"))


def staff_events(events: DataFrame) -> DataFrame:
    """Entries of staff or into hidden zones, customer entries by a door, and their tracks. (A-44)"""
    cust = F.coalesce("class_label", F.lit("")) != "staff"
    e = events.where(F.col("event_type") == C.ENTERED).groupBy("store_id", "external_track_id").agg(
        F.count_if(~cust | F.coalesce("zone_type", F.lit("")).isin(*C.HIDDEN_ZONES)).alias("s"), F.count_if(cust & F.coalesce("zone_type", F.lit("")).isin(*C.ENTRY_ZONES)).alias("d")
    )
    tracks = lambda x: F.count_if(F.col("external_track_id").isNotNull() & (F.col(x) > 0))
    return e.groupBy("store_id").agg(F.sum("s").alias("staff_events"), tracks("s").alias("staff_tracks"), F.sum("d").alias("door_events"), tracks("d").alias("door_tracks"))


def repeated_entries(events: DataFrame, n: int = 10) -> DataFrame:
    """Tracks with more than one customer entry over the threshold, the most frequent first. (A-47)"""
    e = events.where((F.col("event_type") == C.ENTERED) & (F.col("zone_type") == "entry_threshold") & (F.coalesce("class_label", F.lit("")) != "staff"))
    return e.groupBy("external_track_id").agg(F.count("*").alias("entries")).where("entries > 1").orderBy(F.desc("entries"), "external_track_id").limit(n)


def totals(**frames: DataFrame) -> DataFrame:
    """Row counts of several frames side by side. (A-48)"""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


def detections_total(events: DataFrame, start: str, end: str) -> DataFrame:
    """Frames in a period and the detections that their payloads list. (A-49)"""
    e = parsed(events.where((F.col("event_type") == C.FRAME) & C.in_period("occurred_at", start, end)))
    return e.groupBy("store_id").agg(F.count("*").alias("frames"), F.sum(payload_items("$.detections")).alias("detections"))


def events_since(events: DataFrame, since: str) -> DataFrame:
    """Events by camera from a time on. (A-58)"""
    return events.where(F.col("occurred_at") >= F.lit(since).cast("timestamp_ntz")).groupBy("camera_id").agg(F.count("*").alias("events"))


def processing_report(videos: DataFrame) -> DataFrame:
    """(status, frames, events) a video -> totals of a run. (A-59)"""
    return videos.agg(F.count_if(F.col("status") == "Processed").alias("videos_processed"), F.sum("frames").alias("frames_analyzed"), F.sum("events").alias("events_generated"))


def analysis_periods(stores: DataFrame, events: DataFrame, tx: DataFrame, now: str, start: str | None = None, end: str | None = None, default_hours: int = 24) -> DataFrame:
    """(store_id, period_start, period_end) of stores (store_id): from `start`, else from the store's first event or purchase, else `default_hours` before the end, which is `end` or now. (P-06)"""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    until = at(end or now)
    if start is not None:
        return stores.select("store_id", at(start).alias("period_start"), until.alias("period_end"))
    first = events.select("store_id", "occurred_at").union(tx.select("store_id", "occurred_at")).groupBy("store_id").agg(F.min("occurred_at").alias("first_at"))
    return stores.join(first, "store_id", "left").select("store_id", F.coalesce("first_at", until - F.expr(f"interval {default_hours} hours")).alias("period_start"), until.alias("period_end"))


def has_data(df: DataFrame, store_id: str) -> bool:
    """Whether there is a row of the store; one row is read. (A-61)"""
    return bool(df.where(F.col("store_id") == store_id).limit(1).count())


def detection_quality(frames: DataFrame) -> DataFrame:
    """Frame tracks (camera_id, frame_index, global_id, confidence, is_staff) -> quality of each camera. (A-65)

    By frame first, which is small and spread, then by camera; distinct ids are counted once by
    (camera, id).
    """
    f = frames.groupBy("camera_id", "frame_index").agg(F.count("*").alias("people"), F.count_if(~F.col("is_staff")).alias("visitors"), F.sum("confidence").alias("conf"))
    cam = f.groupBy("camera_id").agg(
        F.count("*").alias("frames"), F.sum("people").alias("people"), F.max("people").alias("peak"), F.count_if(F.col("visitors") >= 2).alias("group_frames"), F.sum("conf").alias("conf")
    )
    ids = frames.groupBy("camera_id", "global_id").agg(F.bool_or("is_staff").alias("staff"), F.bool_or(~F.col("is_staff")).alias("visitor"))
    ids = ids.groupBy("camera_id").agg(F.count("*").alias("ids"), F.count_if("staff").alias("staff_ids"), F.count_if("visitor").alias("visitor_ids"))
    return cam.join(ids, "camera_id").select(
        "camera_id", "frames", "people", "peak", "group_frames", "ids", "staff_ids", "visitor_ids", F.round(F.col("conf") / F.col("people"), 6).alias("avg_confidence"), F.round(F.col("group_frames") / F.col("frames"), 6).alias("group_rate")
    )


def contamination(cases: DataFrame) -> DataFrame:
    """(expected_staff, legacy_staff, improved_staff) a case -> staff found, and staff taken for visitors, by both classifiers. (A-55)"""
    missed = lambda x: F.count_if(F.col("expected_staff") & ~F.col(x))
    return cases.agg(
        F.count_if("legacy_staff").alias("legacy_detected"), F.count_if("improved_staff").alias("improved_detected"), missed("legacy_staff").alias("legacy_contamination"), missed("improved_staff").alias("improved_contamination")
    )


def detector_proxies(counts: DataFrame, priors: DataFrame) -> DataFrame:
    """(camera_id, n, confidence) a frame and (camera_id, max_persons, p95_persons, crowd) a camera -> proxies of a detector setting. (A-56)"""
    c = counts.join(F.broadcast(priors), "camera_id", "left").withColumn("most", F.coalesce("max_persons", F.lit(2))).withColumn("busy", F.coalesce("p95_persons", F.lit(1.0)) >= 0.5)
    some, n = F.col("n") >= 1, F.col("n")
    recall = F.when(F.col("busy"), F.when(some, 1.0).otherwise(-1.0)).otherwise(F.when(some, 0.5).otherwise(0.25))
    precision = F.when(n <= F.col("most"), 1.0).when(n == F.col("most") + 1, 0.35).otherwise(-0.5)
    crowd = F.when(F.coalesce("crowd", F.lit(0.0)) >= 0.5, F.when(n >= 2, 1.0).when(n == 1, 0.5).otherwise(-0.5))
    return c.agg(
        F.round(F.avg(recall), 4).alias("recall_proxy"), F.round(F.avg(precision), 4).alias("precision_proxy"), F.round(F.coalesce(F.avg(crowd), F.lit(0.0)), 4).alias("crowd_proxy"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"), F.count("*").alias("frames_scored"),
    )


def window_split(events: DataFrame, since: str) -> DataFrame:
    """Events inside and outside the window that begins at `since`. (A-63, A-66 slices)"""
    late = F.col("occurred_at") >= F.lit(since).cast("timestamp_ntz")
    return events.groupBy("store_id").agg(F.count("*").alias("total"), F.count_if(late).alias("in_window"), F.count_if(~late).alias("outside"))


def latest_feed(events: DataFrame, before: str | None = None) -> DataFrame:
    """Last frame or entry of each store, up to `before`. (A-20)"""
    e = events.where(F.col("event_type").isin(C.FRAME, C.ENTERED))
    e = e.where(F.col("occurred_at") <= F.lit(before).cast("timestamp_ntz")) if before else e
    return e.groupBy("store_id").agg(F.max("occurred_at").alias("last_event"))


def health(events: DataFrame, as_of: str, stale_minutes: float = 15, stores: DataFrame | None = None) -> DataFrame:
    """Age of each store's feed at `as_of`, and the service's status by it. stores: also those without a feed. (A-41)"""
    last = latest_feed(events)
    last = last if stores is None else stores.select("store_id").join(last, "store_id", "left")
    age = C.minutes_between("as_of", "last_event")
    feed = F.when(F.col("last_event").isNull(), "unknown").when(age >= stale_minutes, "stale").otherwise("fresh")
    return last.withColumn("as_of", F.lit(as_of).cast("timestamp_ntz")).select(
        "store_id", F.round(age, 3).alias("age_minutes"), feed.alias("feed"), F.when(feed == "fresh", "ok").otherwise("degraded").alias("status")
    )


def value_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Average, largest and 95th percentile of people a sample, and the traffic class by them. (A-57)"""
    got = df.groupBy(by).agg(F.avg(value).alias("avg_value"), F.max(value).alias("max_value"))
    p = percentiles(df, [by], value, {"p95": 0.95}).withColumnRenamed(by, "by_")
    got = got.join(p, F.col(by).eqNullSafe(F.col("by_")), "left").drop("by_")
    traffic = F.when((F.col("avg_value") >= 8) | (F.col("p95") >= 15), "HIGH").when((F.col("avg_value") >= 3) | (F.col("p95") >= 6), "MEDIUM").when(F.col("avg_value") >= 0.5, "LOW").otherwise("VERY_LOW")
    return got.withColumn("traffic", traffic)


def zone_accuracy(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset true and false positives and false negatives of transitions. (A-53)"""
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    both = n(expected, "want").join(n(actual, "got"), keys, "full").na.fill(0, ["want", "got"])
    s = both.agg(F.sum(F.least("want", "got")).alias("tp"), F.sum(F.greatest(F.col("got") - F.col("want"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("want") - F.col("got"), F.lit(0))).alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    everything = F.nullif(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return s.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"), F.coalesce(F.col("tp") / everything, F.lit(1.0)).alias("accuracy"))


def kpi_audit(truth: DataFrame, engine: DataFrame) -> DataFrame:
    """(kpi, value) twice -> both values and whether they agree. (A-64)"""
    return truth.withColumnRenamed("value", "truth").join(engine.withColumnRenamed("value", "engine"), "kpi", "full").withColumn("match", F.col("truth").eqNullSafe(F.col("engine")))


def dataset_score(found: int, processed: int, t: dict[str, int]) -> int:
    """0 to 100 for a data set: 20 for what is always there, the rest by counts of events, entries, exits, visitors, queue events, transactions, purchases, frames. (A-52)"""
    has = lambda k, n=5: n if t.get(k, 0) > 0 else 0
    score = 20 + has("events") + (15 * processed // found if found else 0) + has("entries") + has("exits") + has("visitors") + has("queue_events")
    score += has("summary", 10) + has("stages") + (5 if t.get("transactions", 0) > 0 and t.get("purchases", 0) > 0 else has("transactions", 2)) + (2 if t.get("layout_mismatches", 0) else 5)
    return min(100, score + (5 if processed == found >= 5 else 0) + min(5, 5 * t.get("frames", 0) // 100) + 5)


def readiness(checks: DataFrame, needed: int = 6) -> DataFrame:
    """(name, passed) -> passed checks and whether there are enough. (A-40)"""
    return checks.agg(F.count_if("passed").alias("passed"), F.count("*").alias("checks"), (F.count_if("passed") >= needed).alias("ready"))
