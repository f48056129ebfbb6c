"""Queries of the retail operators on the adapted tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import bitmaps, geometry, identity, ingest, metrics, moves, sales, visits, zones
from .operators.ordered import settled, shared_folder
from .plans import dashboard
from .sources import adapter, batches, keyindex, pages, readers, versioned
from .streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
START, MIDDLE, END = "2024-01-05 00:00:00", "2024-01-15 00:00:00", "2024-01-24 23:59:59"
EDGES = [("CAM1", "CAM2", "P0", 150.0), ("CAM2", "CAM3", "P0", 150.0), ("CAM3", "CAM4", "P1", 150.0), ("CAM4", "CAM5", "P0", 210.0), ("CAM1", "CAM5", "P0", 210.0)]
VIDEOS = {f"CAM{k}": f"CAM{k}.mp4" for k in range(1, 5)}
TUNED = {"anomalies": {"queue_spike_ratio_warn": 1.01, "dead_zone_ratio": 0.6, "conversion_drop_pp_warn": 0.001, "unknown": 3}}


def _sessions(s, d, keep_staff: bool = False):
    return visits.materialize_sessions(ev(s, d), keep_staff)


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _FOUND[name or f.__name__] = (f, sql if sql is None or sql.lstrip().lower().startswith("with") else f"with recursive {adapter.SQL} {sql}")
        return f

    return add


ev, tx, pos = adapter.events, adapter.transactions, adapter.pos_lines
STAGE = (
    "case when lower(zone_type) in ('entry_threshold','entrance','entry') then 'ENTRY' "
    "when lower(zone_type) in ('browse','browse_skincare','browse_cosmetics','aisle','display','zone','promo_island','consultation') then 'ZONE_VISIT' "
    "when lower(zone_type) in ('checkout','billing_queue','queue','billing') then 'BILLING_QUEUE' when event_type = 'analytics.purchase.completed' then 'PURCHASE' end"
)
ZONE_KEY = "case when zone_id <> '' then 'id:' || zone_id when zone_type <> '' then 'type:' || lower(zone_type) end"
CUST = "lower(coalesce(class_label, '')) <> 'staff' and lower(coalesce(zone_type, '')) not in ('staff_only', 'ignore')"
QUEUE = "(zone_type in ('checkout','billing_queue','queue','billing') or zone_id like '%queue%')"
HOUR = "cast(date_trunc('hour', occurred_at) as timestamp) as bucket_start"
VIS, PERIOD = "event_type like 'vision.%'", f"occurred_at between timestamp '{START}' and timestamp '{END}'"


def _series(where: str, value: str = "cast(count(*) as double)", source: str = "ev") -> str:
    return f"select store_id, {HOUR}, {value} as value, count(*) as sample_count from {source} where {where} group by all"


ROLLUP = f"""select store_id, 'footfall' as metric_name, {HOUR}, cast(date_trunc('hour', occurred_at) as timestamp) + interval 1 hour as bucket_end, 'hour' as granularity, cast(count(*) as double) as value, count(*) as sample_count
from ev where event_type = 'vision.zone.entered' and {CUST} group by all"""


# ------------------------------------------------------------ scans, filters, paging
@query(f"select event_id, store_id, event_type, occurred_at from ev where {PERIOD} and event_type in ('vision.zone.entered', 'vision.zone.exited') order by occurred_at desc, event_id limit 500 offset 20")
def scan_events_paged(s, d):
    e = ev(s, d).where(C.in_period("occurred_at", START, END) & F.col("event_type").isin(C.ENTERED, C.EXITED))
    return readers.page(e, [F.desc("occurred_at"), "event_id"], 20).select("event_id", "store_id", "event_type", "occurred_at")


@query(f"select transaction_id, store_id, cast(amount as double) as amount, occurred_at from tx where status = 'completed'")
def scan_purchases(s, d):
    return tx(s, d).where("status = 'completed'").select("transaction_id", "store_id", F.col("amount").cast("double").alias("amount"), "occurred_at")


@query(f"select external_track_id, store_id, started_at from se where not staff and started_at between timestamp '{START}' and timestamp '{END}'")
def scan_sessions(s, d):
    return visits.materialize_sessions(ev(s, d)).where(C.in_period("started_at", START, END)).select("external_track_id", "store_id", "started_at")


@query("select external_track_id, max(transaction_id) as transaction_id from (select *, row_number() over (partition by external_track_id order by occurred_at desc, transaction_id desc) as rn from tx where external_track_id is not null) where rn = 1 group by 1")
def latest_transaction_by_track(s, d):
    return tx(s, d).where("external_track_id is not null").groupBy("external_track_id").agg(F.max(F.struct("occurred_at", "transaction_id")).alias("x")).select("external_track_id", "x.transaction_id")


@query(f"select event_id, {CUST} as customer, coalesce({QUEUE}, false) as queue, {STAGE} as stage, {ZONE_KEY} as zone_key, regexp_replace(source_video, '.*/', '') as video from ev")
def event_predicates(s, d):
    return ev(s, d).select("event_id", C.is_customer_event().alias("customer"), C.is_queue().alias("queue"), C.stage().alias("stage"), C.zone_key().alias("zone_key"), C.video_name("source_video").alias("video"))


@query("select store_id, external_track_id, status, started_at, n_events from se where not staff and store_id = 'store-1' and status = 'active' and started_at >= timestamp '2024-01-10 00:00:00' order by started_at desc, external_track_id limit 100 offset 5")
def list_sessions(s, d):
    return readers.list_sessions(_sessions(s, d), "store-1", "active", "2024-01-10 00:00:00", None, 5, 100).select("store_id", "external_track_id", "status", "started_at", "n_events")


@query(f"select transaction_id, status, cast(amount as double) as amount, occurred_at from tx where store_id = 'store-2' and {PERIOD} order by occurred_at desc, transaction_id limit 500")
def list_transactions(s, d):
    return readers.list_transactions(tx(s, d), "store-2", START, END, 0, 900).select("transaction_id", "status", F.col("amount").cast("double").alias("amount"), "occurred_at")


@query(f"select store_id, metric_name, bucket_start, value from ({ROLLUP}) where store_id = 'store-0' and bucket_start >= timestamp '{START}' and bucket_end <= timestamp '2024-01-09 11:30:00'", name="list_metrics")
def list_metrics_query(s, d):
    stored = metrics.rollup(metrics.footfall(ev(s, d)), "footfall")
    return readers.list_metrics(stored, "store-0", "footfall", START, "2024-01-09 11:30:00", "hour").select("store_id", "metric_name", "bucket_start", "value")


@query("select store_id, max(external_track_id) as external_track_id, max(started_at) as started_at from (select *, row_number() over (partition by store_id order by started_at desc, external_track_id desc) as rn from se where not staff) where rn = 1 group by 1")
def latest_session(s, d):
    x = _sessions(s, d).groupBy("store_id").agg(F.max(F.struct("started_at", "external_track_id")).alias("x"))
    return x.select("store_id", "x.external_track_id", "x.started_at")


@query("select min(least_) as period_start from (select least((select min(occurred_at) from ev), (select min(occurred_at) from tx)) as least_)")
def analysis_period(s, d):
    a, b = ev(s, d).agg(F.min("occurred_at").alias("a")), tx(s, d).agg(F.min("occurred_at").alias("b"))
    return a.crossJoin(F.broadcast(b)).select(F.least("a", "b").alias("period_start"))


# ------------------------------------------------------------ series and KPIs
@query(_series(f"event_type = 'vision.zone.entered' and {CUST}"))
def footfall_hourly(s, d):
    return metrics.footfall(ev(s, d))


@query(_series(f"{VIS} and {CUST} and external_track_id is not null", "cast(count(distinct external_track_id) as double)"))
def visitors_hourly(s, d):
    return metrics.visitors(ev(s, d))


@query(_series(f"event_type = 'vision.zone.entered' and {CUST} and {QUEUE}"))
def queue_hourly(s, d):
    return metrics.queue_enters(ev(s, d))


@query(_series("status = 'completed'", "cast(sum(amount) as double)", "tx"))
def revenue_hourly(s, d):
    return metrics.revenue(tx(s, d))


@query(_series("status = 'completed'", source="tx"))
def purchases_hourly(s, d):
    return metrics.purchases(tx(s, d))


ZONE_EVENT = "event_type in ('vision.zone.entered','vision.zone.exited')"
IN = "event_type = 'vision.zone.entered'"
HUMAN = "lower(coalesce(class_label, '')) <> 'staff'"
DOOR = "lower(zone_type) in ('entry_threshold','entrance','entry')"
NAMED = "external_track_id is not null and external_track_id <> ''"
EVENT_KPIS = f"""
select store_id, visitors, case when flagged > 0 then flagged when by_zone > 0 then by_zone else by_track end as store_entries, case when exits_flagged > 0 then exits_flagged else exits_ended end as store_exits,
  reentries, staff_events + coalesce((select count(*) from se where se.store_id = k.store_id and staff), 0) as staff_filtered, events, last_event, queue_enters
from (
  select store_id, count(distinct case when {ZONE_EVENT} and {CUST} and {NAMED} then external_track_id end) as visitors,
    count(*) filter ({IN} and is_store_entry) as flagged, count(distinct case when {IN} and {HUMAN} and {DOOR} and {NAMED} then external_track_id end) as by_zone,
    count(distinct case when {IN} and {CUST} and {NAMED} then external_track_id end) as by_track, count(*) filter ({ZONE_EVENT} and is_store_exit) as exits_flagged,
    count(distinct case when event_type = 'vision.track.ended' and {HUMAN} and {NAMED} then external_track_id end) as exits_ended, count(*) filter ({IN} and is_reentry) as reentries,
    count(*) filter (event_type in ('vision.zone.entered','vision.zone.exited','vision.frame.processed') and not ({CUST})) as staff_events, count(*) filter ({VIS}) as events,
    max(case when event_type in ('vision.zone.entered','vision.zone.exited','vision.frame.processed') then occurred_at end) as last_event, count(*) filter ({IN} and {CUST} and {QUEUE}) as queue_enters
  from ev group by 1) k"""


@query(EVENT_KPIS)
def event_kpis(s, d):
    return metrics.event_kpis(ev(s, d), _sessions(s, d, True))


SESSION_KPIS = "select store_id, count(*) as sessions, count(*) filter (not staff) as customer_sessions, count(*) filter (not staff) as session_exits, count(distinct case when not staff then external_track_id end) as session_visitors from se group by 1"


@query(SESSION_KPIS)
def session_kpis(s, d):
    return metrics.session_kpis(_sessions(s, d, True))


@query(f"select store_id, cast(count(*) filter (started_at between timestamp '{START}' and timestamp '{END}') as bigint) as customer_sessions, cast(count(*) filter (ended_at between timestamp '{START}' and timestamp '{END}') as bigint) as session_exits from se where not staff group by 1")
def session_kpis_in_period(s, d):
    return metrics.session_kpis(_sessions(s, d), START, END).select("store_id", "customer_sessions", "session_exits")


@query("select store_id, cast(sum(case when status = 'completed' then amount else 0 end) as double) as revenue, count(*) filter (status = 'completed') as purchases, count(*) filter (status = 'completed' and external_track_id is not null) as linked_purchases from tx group by 1")
def sales_kpis(s, d):
    return metrics.sales_kpis(tx(s, d))


@query("select camera_id, count(*) as events, count(distinct source_video) as videos, cast(max(frame_index) + 1 as bigint) as frame_ceiling, count(*) filter (event_type = 'vision.frame.processed') as frames, count(*) filter (event_type in ('vision.zone.entered','vision.zone.exited','vision.track.ended')) as detections, count(*) filter (is_store_entry) as entries, count(*) filter (is_store_exit) as exits, count(*) filter (is_reentry) as reentries, count(*) filter (event_type = 'vision.zone.entered' and zone_type in ('billing_queue','checkout')) as queue_events, case when count(distinct detector_mode) > 1 then 'mixed' else min(detector_mode) end as detector_mode from ev group by 1")
def coverage_by_camera(s, d):
    return metrics.coverage_by_camera(ev(s, d))


@query(f"""
select store_id, in_period, all_time - in_period as outside, cameras, array_to_string(list_sort(list_distinct(list_concat(vids, list_transform(list_filter(cams, lambda x: x is not null), lambda x: case when x in ('CAM1','CAM2','CAM3','CAM4') then x || '.mp4' else x end)))), ',') as videos,
  cast(len(list_distinct(list_concat(vids, list_transform(list_filter(cams, lambda x: x is not null), lambda x: case when x in ('CAM1','CAM2','CAM3','CAM4') then x || '.mp4' else x end)))) as integer) as n_videos, frame_ceiling,
  case when modes = 1 then mode1 when modes > 1 then 'mixed' end as detector_mode, case when modes = 1 and mode1 = 'mock' then 'mock_trajectory_pipeline' when modes = 1 and mode1 = 'yolo' then 'yolo_cctv_pipeline' when in_period > 0 then 'ingested_events_missing_detector_mode' end as lineage
from (
  select store_id, count(*) filter ({PERIOD}) as in_period, count(*) as all_time, count(distinct case when {PERIOD} then camera_id end) as cameras, list(distinct regexp_replace(source_video, '.*/', '')) filter ({PERIOD}) as vids, list(distinct camera_id) filter ({PERIOD}) as cams,
    count(distinct case when {PERIOD} then detector_mode end) as modes, min(case when {PERIOD} then detector_mode end) as mode1 from ev group by 1
) join (select store_id, cast(sum(top + 1) as bigint) as frame_ceiling from (select store_id, camera_id, max(case when {PERIOD} then frame_index end) as top from ev group by 1, 2) group by 1) using (store_id)""")
def coverage(s, d):
    return metrics.coverage(ev(s, d), START, END, VIDEOS)


@query(f"select zone_type, count(*) as events, count(distinct external_track_id) as tracks from ev where {IN} and {CUST} group by 1")
def zone_breakdown(s, d):
    return metrics.zone_breakdown(ev(s, d))


@query("select event_type, count(*) as events, count(distinct external_track_id) as tracks, count(distinct case when class_label <> 'staff' then external_track_id end) as customer_tracks from ev group by 1")
def type_counts(s, d):
    return metrics.type_counts(ev(s, d))


@query(f"select store_id, count(*) filter (class_label = 'staff' or zone_type in ('staff_only','ignore')) as staff_events, count(distinct case when class_label = 'staff' or zone_type in ('staff_only','ignore') then external_track_id end) as staff_tracks, count(*) filter ({DOOR} and class_label <> 'staff') as door_events, count(distinct case when {DOOR} and class_label <> 'staff' then external_track_id end) as door_tracks from ev where {IN} group by 1")
def staff_events(s, d):
    return metrics.staff_events(ev(s, d))


@query("select external_track_id, count(*) as entries from ev where event_type = 'vision.zone.entered' and zone_type = 'entry_threshold' and class_label <> 'staff' group by 1 having count(*) > 1 order by 2 desc, 1 limit 10")
def repeated_entries(s, d):
    return metrics.repeated_entries(ev(s, d))


@query(f"select store_id, stage, count(*) as raw_events, count(distinct external_track_id) as distinct_tracks from (select store_id, external_track_id, {STAGE} as stage from ev where {IN} and {CUST} and {NAMED}) where stage is not null group by 1, 2 union all select store_id, 'PURCHASE', 0, count(*) from tx where status = 'completed' group by 1")
def stage_audit(s, d):
    return visits.stage_audit(ev(s, d), tx(s, d))


@query("select (select count(*) from ev where event_type = 'analytics.purchase.completed') as purchase_events, (select count(*) from tx where status = 'completed') as completed_tx, (select count(*) from ev) as events")
def purchase_sources(s, d):
    e = ev(s, d)
    return metrics.totals(purchase_events=e.where(F.col("event_type") == C.PURCHASE), completed_tx=tx(s, d).where("status = 'completed'"), events=e)


@query("select store_id, count(*) as frames, cast(sum(n) as bigint) as detections from (select 'store-' || (user_id % 3) as store_id, case when k % 4 = 0 then 0 else k % 4 end as n from (select *, coalesce(try_cast(json_extract_string(props, '$.k') as integer), 0) as k from events)) group by 1")
def detections_total(s, d):
    raw = s.read.parquet(f"{d}/events.parquet").withColumn("k", adapter._k())
    payload = F.when(F.col("k") % 4 == 0, F.lit('{"camera": "x"}')).otherwise(F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.col("k") % 4), lambda x: x).alias("detections"))))
    frames = raw.select(F.concat(F.lit("store-"), F.col("user_id") % 3).alias("store_id"), F.lit(C.FRAME).alias("event_type"), F.col("ts").alias("occurred_at"), payload.alias("payload"))
    return metrics.detections_total(frames, "2000-01-01 00:00:00", "2100-01-01 00:00:00")


@query(f"select camera_id, count(*) as events from ev where occurred_at >= timestamp '{MIDDLE}' group by 1")
def events_since(s, d):
    return metrics.events_since(ev(s, d), MIDDLE)


@query("select count(*) as videos_processed, cast(sum(frames) as bigint) as frames_analyzed, cast(sum(events) as bigint) as events_generated from (select camera_id, max(frame_index) + 1 as frames, count(*) as events from ev group by 1)")
def processing_report(s, d):
    v = ev(s, d).groupBy("camera_id").agg((F.max("frame_index") + 1).alias("frames"), F.count("*").alias("events")).withColumn("status", F.lit("Processed"))
    return metrics.processing_report(v).select("videos_processed", F.col("frames_analyzed").cast("long").alias("frames_analyzed"), "events_generated")


@query("""
select c.camera_id, frames, people, peak, group_frames, ids, staff_ids, visitor_ids, round(conf / people, 6) as avg_confidence, round(group_frames / frames, 6) as group_rate
from (select camera_id, count(*) as frames, cast(sum(n) as bigint) as people, max(n) as peak, count(*) filter (v >= 2) as group_frames, sum(c) as conf from (select camera_id, frame_index, count(*) as n, count(*) filter (not is_staff) as v, sum(confidence) as c from fr group by 1, 2) group by 1) c
join (select camera_id, count(distinct global_id) as ids, count(distinct case when is_staff then global_id end) as staff_ids, count(distinct case when not is_staff then global_id end) as visitor_ids from fr group by 1) using (camera_id)""")
def detection_quality(s, d):
    return metrics.detection_quality(adapter.frames(s, d))


@query("""
select round(avg(case when busy then case when n >= 1 then 1.0 else -1.0 end else case when n >= 1 then 0.5 else 0.25 end end), 4) as recall_proxy,
  round(avg(case when n <= most then 1.0 when n = most + 1 then 0.35 else -0.5 end), 4) as precision_proxy, round(coalesce(avg(case when crowd >= 0.5 then case when n >= 2 then 1.0 when n = 1 then 0.5 else -0.5 end end), 0.0), 4) as crowd_proxy,
  round(avg(c), 4) as avg_confidence, count(*) as frames_scored
from (select camera_id, frame_index, count(*) as n, avg(confidence) as c from fr group by 1, 2) f
left join (select * from (values ('CAM1', 2, 1.0, 0.6), ('CAM2', 1, 0.2, 0.0)) p(camera_id, max_persons, p95_persons, crowd)) using (camera_id), lateral (select coalesce(max_persons, 2) as most, coalesce(p95_persons, 1.0) >= 0.5 as busy)""")
def detector_proxies(s, d):
    n = adapter.frames(s, d).groupBy("camera_id", "frame_index").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    return metrics.detector_proxies(n, s.createDataFrame([("CAM1", 2, 1.0, 0.6), ("CAM2", 1, 0.2, 0.0)], "camera_id string, max_persons int, p95_persons double, crowd double"))


@query(f"select store_id, count(*) as total, count(*) filter (occurred_at >= timestamp '{MIDDLE}') as in_window, count(*) filter (occurred_at < timestamp '{MIDDLE}') as outside from ev group by 1")
def window_coverage(s, d):
    return metrics.window_split(ev(s, d), MIDDLE)


@query(f"select store_id, round((epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(max(occurred_at))) / 6e7, 3) as age_minutes, case when (epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(max(occurred_at))) / 6e7 >= 15 then 'stale' else 'fresh' end as feed, case when (epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(max(occurred_at))) / 6e7 >= 15 then 'degraded' else 'ok' end as status from ev where event_type = 'vision.zone.entered' group by 1")
def feed_health(s, d):
    return metrics.health(ev(s, d), "2024-02-01 00:00:00")


@query("select *, case when avg_value >= 8 or p95 >= 15 then 'HIGH' when avg_value >= 3 or p95 >= 6 then 'MEDIUM' when avg_value >= 0.5 then 'LOW' else 'VERY_LOW' end as traffic from (select camera_id, avg(value) as avg_value, max(value) as max_value, quantile_cont(value, 0.95) as p95 from ev group by 1)")
def value_stats(s, d):
    return metrics.value_stats(ev(s, d), "camera_id", "value")


@query("select camera_id, event_type, count(*) as events from ev group by 1, 2")
def camera_type_matrix(s, d):
    return ev(s, d).groupBy("camera_id", "event_type").agg(F.count("*").alias("events"))


@query(ROLLUP)
def footfall_rollup(s, d):
    return metrics.rollup(metrics.footfall(ev(s, d)), "footfall")


@query(ROLLUP)
def metric_upsert(s, d):
    m = metrics.rollup(metrics.footfall(ev(s, d)), "footfall")
    old = m.where(F.col("bucket_start") < F.lit(MIDDLE).cast("timestamp_ntz")).withColumn("value", F.lit(-1.0))
    return readers.upsert(old, m.withColumn("load_no", F.lit(1).cast("long")), ["store_id", "metric_name", "bucket_start", "granularity"])


@query(ROLLUP)
def metric_resolver(s, d):
    m = metrics.rollup(metrics.footfall(ev(s, d)), "footfall")
    return metrics.resolve(m.where("store_id = 'store-0'"), m)


@query(f"select cast(sum(least(w, g)) as bigint) as tp, cast(sum(greatest(g - w, 0)) as bigint) as fp, cast(sum(greatest(w - g, 0)) as bigint) as fn, sum(least(w, g)) / (sum(least(w, g)) + sum(greatest(g - w, 0))) as precision, sum(least(w, g)) / (sum(least(w, g)) + sum(greatest(w - g, 0))) as recall, 2 * sum(least(w, g)) / (2 * sum(least(w, g)) + sum(greatest(g - w, 0)) + sum(greatest(w - g, 0))) as f1, sum(least(w, g)) / (sum(least(w, g)) + sum(greatest(g - w, 0)) + sum(greatest(w - g, 0))) as accuracy from (select camera_id, zone_type, count(*) filter (detector_mode = 'mock') as w, count(*) filter (detector_mode = 'yolo') as g from ev where zone_type is not null group by 1, 2)")
def zone_accuracy(s, d):
    e = ev(s, d).where("zone_type is not null")
    return metrics.zone_accuracy(e.where("detector_mode = 'mock'"), e.where("detector_mode = 'yolo'"), ["camera_id", "zone_type"])


# ------------------------------------------------------------ visits
@query("select * from se where not staff")
def sessions(s, d):
    return _sessions(s, d)


@query("select external_track_id, store_id, cast(sess as bigint) as sess, started_at, ended_at, n_events from vi")
def visit_gaps(s, d):
    return visits.visit_gaps(ev(s, d))


SIG = f"""
sig as (
  select * from (
    select store_id, 'track:' || external_track_id as visitor_key, {STAGE} as stage, occurred_at as at_ from ev where (event_type = 'vision.zone.entered' and {CUST} or event_type = 'analytics.purchase.completed') and {NAMED}
    union all select store_id, 'track:' || external_track_id, 'PURCHASE', occurred_at from tx where status = 'completed' and external_track_id is not null
  ) where stage is not null
),
st as (
  select store_id, visitor_key, count(*) filter (stage = 'ENTRY') as n1, count(*) filter (stage = 'ZONE_VISIT') as n2, count(*) filter (stage = 'BILLING_QUEUE') as n3, count(*) filter (stage = 'PURCHASE') as n4, count(*) filter (stage is null) as n0
  from (select * from sig union all select store_id, 'track:' || external_track_id, null, started_at from se where not staff) group by 1, 2
),
fu as (
  select store_id, stage, visitors, conv as conversion, round(1 - conv, 4) as drop_off, reentries from (
  select store_id, 'ENTRY' as stage, count(*) as visitors, round(count(*) filter (n2 > 0) / cast(count(*) as double), 4) as conv, cast(sum(greatest(n1 - case when n0 > 0 then 0 else 1 end, 0)) as bigint) as reentries from st group by 1
  union all select store_id, 'ZONE_VISIT', count(*) filter (n2 > 0), round(count(*) filter (n2 > 0 and n3 > 0) / cast(nullif(count(*) filter (n2 > 0), 0) as double), 4), cast(sum(greatest(n2 - 1, 0)) as bigint) from st group by 1
  union all select store_id, 'BILLING_QUEUE', count(*) filter (n3 > 0), round(count(*) filter (n3 > 0 and n4 > 0) / cast(nullif(count(*) filter (n3 > 0), 0) as double), 4), cast(sum(greatest(n3 - 1, 0)) as bigint) from st group by 1
  union all select store_id, 'PURCHASE', count(*) filter (n4 > 0), null, cast(sum(greatest(n4 - 1, 0)) as bigint) from st group by 1)
)"""
WITH_SIG = f"with recursive {adapter.SQL}, {SIG}"


def _signals(s, d):
    return visits.signals(ev(s, d), tx(s, d))


def _funnel(s, d):
    return visits.funnel(visits.visitor_stages(_signals(s, d), _sessions(s, d)))


@query(f"{WITH_SIG} select * from fu")
def funnel(s, d):
    return _funnel(s, d)


@query(f"{WITH_SIG} select store_id, case stage when 'ENTRY' then 'Visitor' when 'ZONE_VISIT' then 'Zone Visit' when 'BILLING_QUEUE' then 'Billing Queue' else 'Purchase' end as label, visitors from fu")
def funnel_labels(s, d):
    return _funnel(s, d).select("store_id", C.stage_label("stage").alias("label"), "visitors")


@query(f"{WITH_SIG} select k.store_id, round(least(p, b) / cast(nullif(b, 0) as double), 6) as billing_to_purchase, round(p / cast(nullif(b, 0) as double), 6) as billing_to_purchase_raw, round(least(p, v) / cast(nullif(v, 0) as double), 6) as purchase_rate, round(p / cast(nullif(v, 0) as double), 6) as purchase_rate_raw, coalesce(round(revenue / nullif(v, 0), 6), 0.0) as revenue_per_visitor from (select store_id, max(case when stage = 'ENTRY' then visitors end) as v, max(case when stage = 'BILLING_QUEUE' then visitors end) as b, max(case when stage = 'PURCHASE' then visitors end) as p from fu group by 1) k left join (select store_id, cast(sum(amount) as double) as revenue from tx where status = 'completed' group by 1) r using (store_id)")
def funnel_ratios(s, d):
    return sales.funnel_ratios(_funnel(s, d), metrics.sales_kpis(tx(s, d)).select("store_id", "revenue"))


@query(f"select store_id, count(*) as orders, cast(sum(amount) as double) as revenue from tx where status = 'completed' and occurred_at between timestamp '{MIDDLE}' and timestamp '{END}' group by 1")
def evening_orders(s, d):
    return sales.time_slice(tx(s, d).where("status = 'completed'"), MIDDLE, END)


JOURNEY = f"""{WITH_SIG},
lt as (select *, 'track:' || external_track_id as visitor_key from (select *, row_number() over (partition by store_id, external_track_id order by occurred_at desc, transaction_id desc) as rn from tx where status = 'completed' and external_track_id is not null) where rn = 1),
zo as (select store_id, 'track:' || external_track_id as visitor_key, string_agg(distinct zone_type, ',' order by zone_type) as zones from ev where event_type in ('vision.zone.entered', 'analytics.purchase.completed') and zone_type <> '' and {NAMED} group by 1, 2),
fs as (select store_id, visitor_key, min(at_) filter (stage = 'ENTRY') as t1, min(at_) filter (stage = 'ZONE_VISIT') as t2, min(at_) filter (stage = 'BILLING_QUEUE') as t3, min(at_) filter (stage = 'PURCHASE') as t4 from sig group by 1, 2),
jo as (
  select *, entry_at is not null and zone_at is not null and billing_at is not null and linked as complete, (entry_at is not null)::int + (zone_at is not null)::int + (billing_at is not null)::int + (purchase_at is not null)::int as stage_count from (
    select fs.store_id, fs.visitor_key, case when lt.transaction_id is not null then coalesce(t1, least(t1, t2, t3, coalesce(t4, lt.occurred_at))) else t1 end as entry_at,
      coalesce(t2, case when lt.transaction_id is not null and (zo.zones is not null or t3 is not null) then coalesce(t3, least(t1, t2, t3, coalesce(t4, lt.occurred_at))) end) as zone_at,
      t3 as billing_at, coalesce(t4, lt.occurred_at) as purchase_at, coalesce(zo.zones, '') as zones, lt.transaction_id, cast(lt.amount as double) as amount, lt.link_method is not null as linked
    from fs left join lt on lt.store_id = fs.store_id and lt.visitor_key = fs.visitor_key left join zo on zo.store_id = fs.store_id and zo.visitor_key = fs.visitor_key)
)"""


def _journeys(s, d):
    return visits.journeys(_signals(s, d), ev(s, d), tx(s, d))


@query(JOURNEY + " select * from jo")
def journeys(s, d):
    return _journeys(s, d)


@query(JOURNEY + " select store_id, visitor_key, complete, amount from jo order by complete desc, coalesce(amount, 0) desc, store_id, visitor_key limit 50")
def first_journeys(s, d):
    return readers.page(_journeys(s, d), visits.journey_order(), 0, 50).select("store_id", "visitor_key", "complete", "amount")


@query(JOURNEY + " select s.*, t.linked_purchases, t.orphan_purchases from (select store_id, count(*) as journeys, count(*) filter (complete) as complete, count(billing_at) as with_billing, round(count(*) filter (billing_at is not null and transaction_id is not null) / cast(nullif(count(billing_at), 0) as double), 4) as billing_to_purchase from jo group by 1) s left join (select store_id, count(*) filter (external_track_id is not null and link_method is not null) as linked_purchases, count(*) filter (external_track_id is null) as orphan_purchases from tx where status = 'completed' group by 1) t using (store_id)")
def journey_summary(s, d):
    return visits.journey_summary(_journeys(s, d), tx(s, d))


@query(f"{WITH_SIG} select store_id, count(*) filter (n1 > 0 and n2 > 0) as entry_zone, count(*) filter (n2 > 0 and n3 > 0) as zone_billing, count(*) filter (n1 > 0 and n3 > 0) as entry_billing from st where n1 + n2 + n3 + n4 > 0 group by 1")
def stage_overlap(s, d):
    return visits.stage_overlap(_signals(s, d))


# ------------------------------------------------------------ zones and anomalies
def _heat(key: str, label: str, source: str = "ev") -> str:
    return f"""
zz as (
  select store_id, zone_key, count(*) filter (event_type = 'vision.zone.entered') as visits, arg_min(zone_label, struct_pack(a := occurred_at, b := zone_label)) as zone_label,
    avg(case when event_type = 'vision.zone.exited' and dwell_ms >= 0 then dwell_ms / 1000 end) as avg_dwell, count(case when event_type = 'vision.zone.exited' and dwell_ms >= 0 then 1 end) as samples
  from (select *, {key} as zone_key, {label} as zone_label from {source}) where zone_key is not null and (event_type = 'vision.zone.entered' or event_type = 'vision.zone.exited' and dwell_ms is not null) and {CUST} group by 1, 2
),
he as (
  select store_id, zone_key, zone_label, visits, samples, round(avg_dwell, 2) as avg_dwell,
    round(case when max(visits) over w <= min(visits) over w then case when visits > 0 then 1.0 else 0.0 end else (visits - min(visits) over w) / cast(max(visits) over w - min(visits) over w as double) end, 4) as visit_norm,
    round(case when samples = 0 then 0.0 when max(avg_dwell) over w <= min(avg_dwell) over w then case when avg_dwell > 0 then 1.0 else 0.0 end else (avg_dwell - min(avg_dwell) over w) / (max(avg_dwell) over w - min(avg_dwell) over w) end, 4) as dwell_norm,
    case when visits < 3 then 'LOW' when visits >= 5 and samples / cast(visits as double) >= 0.5 then 'HIGH' when samples = 0 then 'LOW' else 'MEDIUM' end as confidence
  from zz window w as (partition by store_id)
)"""


HEAT = _heat(ZONE_KEY, "coalesce(zone_type, zone_id)")


@query(f"with recursive {adapter.SQL}, {HEAT} select * from he")
def heatmap(s, d):
    return zones.heatmap(ev(s, d))


@query(f"with recursive {adapter.SQL}, {HEAT} select store_id, zone_key, visits from he order by visits desc, zone_key, store_id limit 5")
def busiest_zones(s, d):
    return zones.heatmap(ev(s, d)).orderBy(*zones.zone_order(), "store_id").limit(5).select("store_id", "zone_key", "visits")


LAYOUT = {
    "sections": {"foh": {"label": "Front of house"}}, "layout_zones": [{"id": "wall", "label": "Skincare wall", "section": "foh"}, {"id": "till", "label": "Cash counter", "section": "back"}],
    "camera_zone_mapping": {f"zone-{k}": "wall" for k in range(4)}, "zone_type_mapping": {"billing_queue": "till", "aisle": None}, "brand_bays": {"wall": [{"brand": "A"}, {"brand": "B"}]},
}
LAYOUT_ID = "case when zone_id in ('zone-0','zone-1','zone-2','zone-3') then 'wall' when zone_type = 'billing_queue' then 'till' end"
LAID = f"(select *, {LAYOUT_ID} as layout_id from ev)"


@query(f"with recursive {adapter.SQL}, {_heat(f'case when layout_id is not null then {chr(39)}layout:{chr(39)} || layout_id else {ZONE_KEY} end', f'case layout_id when {chr(39)}wall{chr(39)} then {chr(39)}Skincare wall{chr(39)} when {chr(39)}till{chr(39)} then {chr(39)}Cash counter{chr(39)} else coalesce(zone_type, zone_id) end', LAID)} select store_id, zone_key, zone_label, visits, samples, avg_dwell, case zone_key when 'layout:wall' then 'Front of house' when 'layout:till' then 'back' end as section from he")
def layout_heatmap(s, d):
    f = readers.layout_frames(s, LAYOUT)
    h = zones.heatmap(zones.layout_keys(zones.remap_zones(ev(s, d), f["camera_zones"], f["zone_types"]), f["zones"]).drop("layout_id", "section_label"))
    names = F.broadcast(f["zones"].select(F.concat(F.lit("layout:"), "layout_id").alias("zone_key"), F.col("section_label").alias("section")))
    return h.join(names, "zone_key", "left").select("store_id", "zone_key", "zone_label", "visits", "samples", "avg_dwell", "section")


@query("select * from (values ('CAM1', 'zone-0', 'wall', 'Skincare wall', true), ('CAM1', 'zone-77', 'till', 'Cash counter', false), ('CAM2', 'zone-5', 'till', 'Cash counter', true), ('CAM2', 'zone-6', cast(null as varchar), 'corner', true)) t(camera_id, zone_id, layout_id, store_name, in_db)")
def zone_catalogue(s, d):
    f = readers.layout_frames(s, LAYOUT)
    cameras = {"CAM1": [{"zone_id": "zone-0", "name": "left", "points": []}, {"zone_id": "zone-77", "name": "counter", "layout_zone_id": "till", "points": []}], "CAM2": [{"zone_id": "zone-5", "name": "counter", "points": []}, {"zone_id": "zone-6", "name": "corner", "points": []}]}
    generic = s.createDataFrame([("counter", "till")], "name string, layout_id string")
    return zones.zone_catalogue(readers.zones_frame(s, cameras), f["camera_zones"], generic, f["zones"], ev(s, d))


HEAT_CONF = "select store_id, case when bool_or(confidence = 'LOW') then 'LOW' when bool_or(confidence = 'MEDIUM') then 'MEDIUM' else 'HIGH' end as confidence, count(*) as zones, cast(sum(visits) as bigint) as zone_visits, round(sum(avg_dwell * samples) / nullif(sum(samples), 0), 6) as weighted_dwell from he group by 1"


@query(f"with recursive {adapter.SQL}, {HEAT} {HEAT_CONF}")
def heatmap_confidence(s, d):
    return zones.heatmap_confidence(zones.heatmap(ev(s, d)))


COUNTS = f"""cnt as (
  select store_id, zone_key, count(*) filter (occurred_at >= timestamp '{MIDDLE}') as current, count(*) filter (occurred_at < timestamp '{MIDDLE}') as baseline, arg_min(label, struct_pack(a := occurred_at, b := label)) as zone_label
  from (select *, {ZONE_KEY} as zone_key, coalesce(zone_type, zone_id) as label from ev) where zone_key is not null and {IN} and {CUST} and {PERIOD} group by 1, 2
)"""
WITH_COUNTS = f"with recursive {adapter.SQL}, {COUNTS}"


def _counts(s, d):
    return zones.zone_counts(ev(s, d), START, MIDDLE, END)


@query(f"{WITH_COUNTS} select * from cnt")
def zone_counts(s, d):
    return _counts(s, d)


def _spikes(warn: float) -> str:
    return f"select store_id, zone_key, 'QUEUE_SPIKE' as anomaly_type, case when current / cast(baseline as double) >= 2.5 then 'CRITICAL' else 'WARN' end as severity, round(current / cast(baseline as double), 6) as measure, printf('Queue spike in %s: %d visits vs baseline %d (%.1fx).', zone_label, current, baseline, current / cast(baseline as double)) as message from cnt where (zone_key in ('type:checkout','type:billing_queue','type:queue','type:billing') or regexp_replace(zone_key, '^[^:]*:', '') in ('checkout','billing_queue','queue','billing')) and baseline >= 5 and current > baseline and current / cast(baseline as double) >= {warn}"


def _dead(ratio: float) -> str:
    return f"select store_id, zone_key, 'DEAD_ZONE' as anomaly_type, case when share < {ratio} / 2 then 'WARN' else 'INFO' end as severity, round(share, 6) as measure, printf('Dead zone detected: %s had only %d visits (%.1f%% of store traffic, peak zone %d).', zone_label, current, share * 100, peak) as message from (select *, max(current) over w as peak, cast(sum(current) over w as bigint) as total, count(*) over w as n, current / cast(sum(current) over w as double) as share from cnt where current > 0 window w as (partition by store_id)) where n >= 2 and total >= 20 and current <= {ratio} * peak"


@query(f"{WITH_COUNTS} {_spikes(1.5)}")
def queue_spikes(s, d):
    return zones.queue_spikes(_counts(s, d))


@query(f"{WITH_COUNTS} {_spikes(1.01)}")
def queue_spikes_of_a_store(s, d):
    return zones.queue_spikes(_counts(s, d), zones.thresholds(TUNED))


@query(f"{WITH_COUNTS} {_dead(0.05)}")
def dead_zones(s, d):
    return zones.dead_zones(_counts(s, d))


@query(f"{WITH_COUNTS} {_dead(0.6)}")
def dead_zones_of_a_store(s, d):
    return zones.dead_zones(_counts(s, d), zones.thresholds(TUNED))


STALE = "select store_id, 'feed' as zone_key, 'STALE_FEED' as anomaly_type, case when m >= 60 then 'CRITICAL' else 'WARN' end as severity, m as measure, printf('Vision feed stale: last event %.0f minutes ago.', m) as message from (select store_id, round((epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(max(occurred_at))) / 6e7, 3) as m from ev where event_type in ('vision.zone.entered', 'vision.frame.processed') group by 1) where m >= 15"


@query(STALE)
def stale_feeds(s, d):
    return zones.stale_feeds(metrics.health(ev(s, d), "2024-02-01 00:00:00"))


def _rate(a: str, b: str, more: str = "true") -> str:
    inside = f"at_ between timestamp '{a}' and timestamp '{b}' and {more}"
    return f"(select store_id, count(*) as n, count(*) filter (p) as bought, count(*) filter (p) / cast(count(*) as double) as r from (select store_id, visitor_key, coalesce(bool_or(stage = 'PURCHASE'), false) as p from (select store_id, visitor_key, stage, at_ from sig where {inside} union all select store_id, 'track:' || external_track_id, null, started_at from (select *, started_at as at_ from se) where not staff and {inside}) group by 1, 2) group by 1)"


def _drops(warn: float) -> str:
    return f"""{WITH_SIG} select a.store_id, 'global' as zone_key, 'CONVERSION_DROP' as anomaly_type, case when b.r - a.r >= 0.3 then 'CRITICAL' else 'WARN' end as severity, round(b.r - a.r, 6) as measure,
      printf('Conversion dropped %.0f%% (baseline %.0f%% → current %.0f%%, %d/%d purchases).', (b.r - a.r) * 100, b.r * 100, a.r * 100, a.bought, a.n) as message
    from {_rate(MIDDLE, END)} a join {_rate(START, MIDDLE, f"at_ < timestamp '{MIDDLE}'")} b using (store_id) where a.n >= 10 and b.r - a.r >= {warn}"""


def _conversions(s, d):
    # Whole windows, as in zone_counts: [MIDDLE, END] against [START, MIDDLE).
    e, t = ev(s, d), tx(s, d)
    ses, middle = visits.materialize_sessions(e), F.lit(MIDDLE).cast("timestamp_ntz")

    def rate(a, b, inside):
        part = lambda df, at="occurred_at": df.where(C.in_period(at, a, b) & inside(F.col(at)))
        return visits.conversion(visits.visitor_stages(visits.signals(part(e), part(t)), part(ses, "started_at")))

    return rate(MIDDLE, END, lambda at: at >= middle), rate(START, MIDDLE, lambda at: at < middle)


@query(_drops(0.15))
def conversion_drops(s, d):
    return zones.conversion_drops(*_conversions(s, d))


@query(_drops(0.001))
def conversion_drops_of_a_store(s, d):
    return zones.conversion_drops(*_conversions(s, d), zones.thresholds(TUNED))


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr({h}, 17, 1))::int & 3), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


STORED = [("store-0", "id:zone-1", "dead_zone", "warning", 0.01, "old", "2024-01-20 00:00:00", "a1"), ("store-0", "feed", "stale_feed", "critical", 70.0, "old", "2024-01-20 00:00:00", "a2"), ("store-1", "x", "theft", "high", None, "old", "2024-01-19 00:00:00", "a3")]


@query(f"""{WITH_COUNTS}, co as (select *, timestamp '2024-02-01 00:10:00' as detected_at, {_uuid5("store_id || ':' || anomaly_type || ':' || zone_key || ':2024-02-01T00:00:00+00:00'")} as anomaly_id, 'computed' as source from ({_dead(0.6)} union all {STALE})),
pe as (select * from (values ('store-0', 'id:zone-1', 'DEAD_ZONE', 'WARN', 0.01, 'old', timestamp '2024-01-20 00:00:00', 'a1', 'persisted'), ('store-0', 'feed', 'STALE_FEED', 'CRITICAL', 70.0, 'old', timestamp '2024-01-20 00:00:00', 'a2', 'persisted'), ('store-1', 'x', 'THEFT', 'HIGH', null, 'old', timestamp '2024-01-19 00:00:00', 'a3', 'persisted')) t(store_id, zone_key, anomaly_type, severity, measure, message, detected_at, anomaly_id, source))
select * from co union all select * from pe where not exists (select 1 from co where co.store_id = pe.store_id and co.anomaly_type = pe.anomaly_type)""")
def anomalies(s, d):
    computed = zones.dead_zones(_counts(s, d), zones.thresholds(TUNED)).unionByName(zones.stale_feeds(metrics.health(ev(s, d), "2024-02-01 00:00:00")))
    stored = s.createDataFrame(STORED, "store_id string, zone_key string, anomaly_type string, severity string, measure double, message string, detected_at string, anomaly_id string").withColumn("detected_at", F.col("detected_at").cast("timestamp_ntz"))
    return zones.merge_anomalies(zones.anomaly_ids(computed, NAMESPACE, "2024-02-01 00:10:00"), stored).orderBy(*zones.anomaly_order())


# ------------------------------------------------------------ sales
@query("select order_id, cast(sum(nmv) as double) as nmv, cast(sum(gmv) as double) as gmv, count(*) as line_count, cast(sum(qty) as bigint) as qty, arg_min(brand_name, struct_pack(a := line_no, b := brand_name)) as first_brand_name from pos group by 1")
def pos_orders(s, d):
    return sales.orders(pos(s, d))


@query("select order_id, category, cast(sum(nmv) as double) as nmv, count(*) as line_count from pos group by 1, 2")
def pos_order_categories(s, d):
    return sales.order_parts(pos(s, d), "category")


@query("select brand_name, cast(sum(nmv) as double) as nmv, count(*) as line_count from pos group by 1 order by 2 desc, 1 limit 5")
def top_brands(s, d):
    return sales.top_by_revenue(pos(s, d), "brand_name")


@query("select category, cast(sum(nmv) as double) as nmv, count(*) as line_count from pos group by 1 order by 2 desc, 1 limit 5")
def top_categories(s, d):
    return sales.top_by_revenue(pos(s, d), "category")


@query("select order_id, brand_name, nmv, line_count, cast(rn as integer) as rn from (select *, row_number() over (partition by order_id order by nmv desc, brand_name) as rn from (select order_id, brand_name, cast(sum(nmv) as double) as nmv, count(*) as line_count from pos group by 1, 2)) where rn <= 3")
def top_brands_per_order(s, d):
    return sales.top_per_order(pos(s, d), 3)


@query("select cast(sum(nmv) as double) as revenue, count(distinct order_id) as orders, count(*) as line_count, round(cast(sum(nmv) as double) / count(distinct order_id), 4) as aov from pos")
def pos_totals(s, d):
    return sales.totals(pos(s, d))


BILL = f"bi as (select store_id, external_track_id, min(occurred_at) as billing_at, count(*) as billing_events from ev where event_type = 'vision.zone.entered' and {CUST} and zone_type in ('checkout','billing_queue','queue','billing') and external_track_id is not null group by 1, 2)"


@query(f"with recursive {adapter.SQL}, {BILL} select * from bi")
def billing_candidates(s, d):
    return sales.billing_candidates(ev(s, d))


@query(f"with recursive {adapter.SQL}, {BILL} select b.store_id, b.external_track_id, t.transaction_id, 'SEQUENTIAL' as method, cast(0.75 as double) as confidence from (select *, row_number() over (partition by store_id order by billing_at, external_track_id) as rn from bi) b join (select *, row_number() over (partition by store_id order by occurred_at, transaction_id) as rn from tx where status = 'completed') t using (store_id, rn)")
def link_sequential(s, d):
    return sales.link_sequential(sales.billing_candidates(ev(s, d)), tx(s, d))


@query(f"with recursive {adapter.SQL}, {BILL}, nr as (select b.store_id, b.external_track_id, t.transaction_id, abs(epoch_us(b.billing_at) - epoch_us(t.occurred_at)) as d from bi b join tx t on t.store_id = b.store_id and t.status = 'completed' and abs(epoch_us(b.billing_at) - epoch_us(t.occurred_at)) <= 86400000000) select store_id, external_track_id, transaction_id, d / 1e6 as delta_s, round(greatest(0.0, 1 - d / 86400000000.0), 3) as confidence from (select *, row_number() over (partition by store_id, external_track_id order by d, transaction_id) as rn from nr) where rn = 1")
def nearest_order(s, d):
    return sales.nearest_order(sales.billing_candidates(ev(s, d)), tx(s, d), 86400)


@query(f"""with recursive {adapter.SQL}, {BILL},
o as (select store_id, transaction_id, epoch_us(occurred_at) as us, row_number() over (partition by store_id order by occurred_at, cast(transaction_id as varchar)) as pos from tx where status = 'completed'),
b as (select store_id, external_track_id, epoch_us(billing_at) as us, row_number() over (partition by store_id order by billing_at, external_track_id) as i from bi),
near as (select b.store_id, b.i, b.external_track_id, list(struct_pack(d := abs(o.us - b.us), pos := o.pos, id := o.transaction_id) order by abs(o.us - b.us), o.pos) as options from b join o on o.store_id = b.store_id and abs(o.us - b.us) <= 1200000000 group by 1, 2, 3),
n2 as (select *, row_number() over (partition by store_id order by i) as k from near),
gr(store_id, k, external_track_id, used, hit) as (
  select store_id, 1, external_track_id, [options[1].id], options[1] from n2 where k = 1
  union all
  select n2.store_id, n2.k, n2.external_track_id, case when len(list_filter(n2.options, lambda x: not list_contains(gr.used, x.id))) > 0 then list_append(gr.used, list_filter(n2.options, lambda x: not list_contains(gr.used, x.id))[1].id) else gr.used end, list_filter(n2.options, lambda x: not list_contains(gr.used, x.id))[1]
  from gr join n2 on n2.store_id = gr.store_id and n2.k = gr.k + 1
),
ti as (select store_id, external_track_id, cast(hit.id as varchar) as transaction_key, 'TIME_WINDOW' as method, round(greatest(0.0, 1 - hit.d / 1200000000.0), 3) as confidence from gr where hit is not null),
lb as (select *, row_number() over (partition by store_id order by us, external_track_id) as rn from b where not exists (select 1 from ti where ti.store_id = b.store_id and ti.external_track_id = b.external_track_id)),
lo as (select store_id, transaction_id, row_number() over (partition by store_id order by us, transaction_id) as rn from o where not exists (select 1 from ti where ti.store_id = o.store_id and ti.transaction_key = cast(o.transaction_id as varchar)))
select * from ti union all select lb.store_id, lb.external_track_id, cast(lo.transaction_id as varchar), 'SEQUENTIAL', 0.75 from lb join lo using (store_id, rn)""")
def link_orders(s, d):
    return sales.link_orders(sales.billing_candidates(ev(s, d)), tx(s, d), 1200)


@query("select * from (select name, cast(sum(amount) as double) as nmv from (select amount, unnest(case when transaction_id % 2 = 0 then ['A', 'B'] else ['C'] end) as name from tx where status = 'completed') group by 1) order by nmv desc, name limit 2")
def top_brands_of_metadata(s, d):
    part = lambda n: F.struct(F.lit(n).alias("name"), F.col("amount").cast("string").alias("nmv"))
    t = tx(s, d).withColumn("metadata", F.to_json(F.struct(F.when(F.col("transaction_id") % 2 == 0, F.array(part("A"), part("B"))).otherwise(F.array(part("C"))).alias("brands"))))
    return sales.top_from_metadata(t, "brands", 2)


# ------------------------------------------------------------ identity
PRES = f"pr as (select store_id, external_track_id, camera_id, count(*) as events, min(occurred_at) as first_at, max(occurred_at) as last_at, list_sort(list(distinct zone_type) filter (zone_type <> '')) as zone_types from ev where {VIS} and {NAMED} and camera_id <> '' group by 1, 2, 3)"


@query(f"with recursive {adapter.SQL}, {PRES} select * replace (array_to_string(coalesce(zone_types, []), ',') as zone_types) from pr")
def presence(s, d):
    return identity.presence(ev(s, d)).withColumn("zone_types", F.array_join("zone_types", ","))


CROSS = "select store_id, external_track_id, count(*) as cameras, cast(sum(events) as bigint) as events, string_agg(case camera_id when 'CAM1' then 'Door' else right(camera_id, 4) end, ' → ' order by first_at, camera_id) as path, right(external_track_id, 12) as suffix from pr group by 1, 2 having count(*) >= 2"


@query(f"with recursive {adapter.SQL}, {PRES} {CROSS}")
def cross_camera(s, d):
    return identity.cross_camera(identity.presence(ev(s, d)), {"CAM1": "Door"})


@query(f"with recursive {adapter.SQL}, {PRES} {CROSS} order by cameras desc, events desc, store_id, external_track_id limit 15")
def first_cross_camera(s, d):
    return identity.cross_camera(identity.presence(ev(s, d)), {"CAM1": "Door"}).orderBy(*identity.cross_camera_order()).limit(15)


@query(f"with recursive {adapter.SQL}, {PRES} select store_id, count(*) as unique_tracks, count(*) filter (n = 1) as single_camera, count(*) filter (n > 1) as cross_camera from (select store_id, external_track_id, count(*) as n from pr group by 1, 2) group by 1")
def camera_counts(s, d):
    return identity.camera_counts(identity.presence(ev(s, d)))


HAND = "select a.store_id, e.src, e.dst, e.priority, a.external_track_id as from_track, b.external_track_id as to_track, (epoch_us(b.first_at) - epoch_us(a.last_at)) / 1e6 as gap_seconds, 'temporal_handoff_unlinked_ids' as reason from pr a join ed e on e.src = a.camera_id join pr b on b.store_id = a.store_id and b.camera_id = e.dst and a.external_track_id <> b.external_track_id where (epoch_us(b.first_at) - epoch_us(a.last_at)) / 1e6 between 0 and e.gap_s"
EDGE_SQL = "ed(src, dst, priority, gap_s) as (values " + ", ".join(f"('{a}', '{b}', '{p}', {g})" for a, b, p, g in EDGES) + ")"


def _handoffs(s, d):
    return identity.handoffs(identity.presence(ev(s, d)), s.createDataFrame(EDGES, "src string, dst string, priority string, gap_s double"), 210)


@query(f"with recursive {adapter.SQL}, {PRES}, {EDGE_SQL} {HAND}")
def handoffs(s, d):
    return _handoffs(s, d)


@query(f"with recursive {adapter.SQL}, {PRES}, {EDGE_SQL} {HAND} order by gap_seconds, a.store_id, from_track, to_track, src, dst limit 20")
def first_handoffs(s, d):
    return _handoffs(s, d).orderBy(*identity.handoff_order()).limit(20)


@query("select store_id, camera_id, count(*) filter (was <> external_track_id) as switches, count(distinct external_track_id) as tracks from (select *, lag(external_track_id) over (partition by store_id, camera_id order by occurred_at, event_id) as was from ev) group by 1, 2")
def id_switches(s, d):
    return identity.id_switches(ev(s, d))


@query("""select *, round(greatest(0.0, 1 - abs(visitor_ids - 100) / 100.0), 4) as visitor_id_accuracy, round(greatest(0.0, 1 - abs(visitor_sessions - 120) / 120.0), 4) as session_accuracy, round(switches / cast(greatest(fragments, 1) as double), 4) as id_switch_rate, round(least(1.0, top_cameras / 4.0), 4) as link_score,
  round(0.35 * greatest(0.0, 1 - abs(visitor_ids - 100) / 100.0) + 0.25 * greatest(0.0, 1 - abs(visitor_sessions - 120) / 120.0) + 0.2 * (1 - least(1.0, switches / cast(greatest(fragments, 1) as double) * 4)) + 0.2 * least(1.0, top_cameras / 4.0), 4) as overall_score
from (select count(*) as unique_ids, count(*) filter (not staff) as visitor_ids, count(*) filter (cams >= 2) as links, cast(coalesce(max(case when not staff then cams end), 0) as integer) as top_cameras from (select global_id, bool_or(is_staff) as staff, count(distinct camera_id) as cams from fr group by 1)),
  (select count(*) as fragments, cast(sum(n) as bigint) as switches from (select camera_id, local_track_id, count(*) filter (was <> global_id) as n from (select *, lag(global_id) over (partition by camera_id, local_track_id order by ts, global_id) as was from fr) group by 1, 2)),
  (select cast(sum(n) as bigint) as visitor_sessions, cast(sum(n - 1) as bigint) as duplicate_sessions from (select external_track_id, count(*) as n from se where not staff group by 1))""")
def reid_metrics(s, d):
    return identity.reid_metrics(adapter.frames(s, d), _sessions(s, d), 100, 120)


@query("""select event_id, round(path_length, 9) as path_length, round(net, 9) as net, points, round(path_length / greatest(net, 0.005), 6) as loiter_ratio from (
  select *, sum(step) over (w rows unbounded preceding) as path_length, sqrt(pow(foot_x - first_value(foot_x) over (w rows between 119 preceding and current row), 2) + pow(foot_y - first_value(foot_y) over (w rows between 119 preceding and current row), 2)) as net, count(*) over (w rows between 119 preceding and current row) as points
  from (select *, coalesce(sqrt(pow(foot_x - lag(foot_x) over v, 2) + pow(foot_y - lag(foot_y) over v, 2)), 0.0) as step from fr window v as (partition by store_id, camera_id, local_track_id order by ts, event_id)) window w as (partition by store_id, camera_id, local_track_id order by ts, event_id))""")
def movement(s, d):
    return identity.movement(adapter.frames(s, d)).select("event_id", F.round("path_length", 9).alias("path_length"), F.round("net", 9).alias("net"), "points", F.round("loiter_ratio", 6).alias("loiter_ratio"))


@query("select store_id, external_track_id, cast(sum(m) as bigint) as transitions, cast(max(r) as bigint) as most_recent from (select *, sum(m) over (partition by store_id, external_track_id order by occurred_at, event_id rows between 23 preceding and current row) as r from (select *, case when lag(zone_type) over (partition by store_id, external_track_id order by occurred_at, event_id) <> zone_type then 1 else 0 end as m from ev where zone_type is not null)) group by 1, 2")
def zone_shuttles(s, d):
    return identity.shuttles(ev(s, d))


@query("select distinct a.event_id from ev a join ev b on a.store_id = b.store_id and a.external_track_id = b.external_track_id and a.camera_id <> b.camera_id and a.event_type = 'vision.zone.entered' and b.event_type = 'vision.zone.entered' and epoch_us(a.occurred_at) - epoch_us(b.occurred_at) between 1 and 600000000")
def overlap_suppressed(s, d):
    return identity.overlap_suppressed(ev(s, d), 600)


@query("select a.vec_id, b.vec_id as other, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def appearance_similarity(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    return e.join(o, "vec_id").select("vec_id", "other", F.round(C.cosine("embedding", "e2"), 9).alias("similarity"))


# ------------------------------------------------------------ ingest
BATCH = "bt as (select event_id as idx, cast(event_id % 9000 as varchar) as event_id, case when event_id % 11 = 0 then 'bad.type' else event_type end as event_type, '1.0.0' as schema_version, case when event_id % 13 = 0 then 'tenant-9' end as tenant_id, case when event_id % 17 = 0 then 'store-9' else store_id end as store_id, 'key-' || (event_id % 9500) as idempotency_key from ev)"


def _batch(s, d):
    return ev(s, d).select(
        F.col("event_id").alias("idx"), (F.col("event_id") % 9000).cast("string").alias("event_id"), F.when(F.col("event_id") % 11 == 0, "bad.type").otherwise(F.col("event_type")).alias("event_type"), F.lit("1.0.0").alias("schema_version"),
        F.when(F.col("event_id") % 13 == 0, "tenant-9").alias("tenant_id"), F.when(F.col("event_id") % 17 == 0, "store-9").otherwise(F.col("store_id")).alias("store_id"), F.concat(F.lit("key-"), F.col("event_id") % 9500).alias("idempotency_key"), F.lit("{}").alias("payload"),
    )


def _validated(s, d):
    stores = s.createDataFrame([(f"store-{k}", "tenant-1") for k in range(3)], "known_store string, known_tenant string")
    return ingest.validate(_batch(s, d), F.broadcast(stores))


VALID = f"""with recursive {adapter.SQL}, {BATCH},
v0 as (select *, event_type <> 'bad.type' and store_id <> 'store-9' and tenant_id is null as sound from bt),
v1 as (select *, coalesce(sum(sound::int) over (partition by event_id order by idx rows between unbounded preceding and 1 preceding), 0) > 0 as again_id from v0),
v2 as (select *, coalesce(sum((sound and not again_id)::int) over (partition by idempotency_key order by idx rows between unbounded preceding and 1 preceding), 0) > 0 as again_key from v1),
va as (
  select idx, tenant_id as t, store_id, list_filter([case when event_type = 'bad.type' then 'invalid_event_type' end, case when again_id then 'duplicate_event_id_in_batch' end, case when again_key then 'duplicate_idempotency_key_in_batch' end,
    case when event_type <> 'bad.type' and not again_id and not again_key and store_id = 'store-9' then 'store_not_found' end, case when event_type <> 'bad.type' and not again_id and not again_key and tenant_id is not null and store_id <> 'store-9' then 'tenant_store_mismatch' end], lambda x: x is not null) as errors from v2)"""


@query(VALID + " select idx, array_to_string(errors, ',') as errors, case when len(errors) = 0 then 'accepted' else 'rejected' end as status, coalesce(t, case when store_id <> 'store-9' then 'tenant-1' end) as tenant_id from va")
def validate_events(s, d):
    return _validated(s, d).select("idx", F.array_join("errors", ",").alias("errors"), "status", "tenant_id")


@query(VALID + " select count(*) filter (len(errors) = 0) as accepted, count(*) filter (len(errors) > 0) as rejected, 0::bigint as duplicate, 207 as code from va")
def ingest_summary(s, d):
    return ingest.summary(_validated(s, d))


@query(f"with recursive {adapter.SQL}, {BATCH} select idx, case when cast(event_id as bigint) % 3 = 0 or row_number() over (partition by event_id order by idx) > 1 then 'duplicate_id' when cast(substr(idempotency_key, 5) as bigint) % 5 = 0 or row_number() over (partition by idempotency_key order by idx) > 1 then 'duplicate_key' else 'created' end as outcome from bt")
def idempotent_insert(s, d):
    b = _batch(s, d)
    stored = b.where("cast(event_id as bigint) % 3 = 0").select("event_id", F.lit(None).cast("string").alias("idempotency_key")).union(
        b.where("cast(substr(idempotency_key, 5) as bigint) % 5 = 0").select(F.lit(None).cast("string"), "idempotency_key")
    )
    return readers.split_new_events(b, stored).select("idx", "outcome")


@query(f"with recursive {adapter.SQL}, {BATCH} select idx, case when cast(event_id as bigint) % 3 = 0 or row_number() over (partition by event_id order by idx) > 1 then 'duplicate_id' when cast(substr(idempotency_key, 5) as bigint) % 5 = 0 or row_number() over (partition by idempotency_key order by idx) > 1 then 'duplicate_key' else 'created' end as outcome from bt")
def idempotent_insert_indexed(s, d):
    """idempotent_insert against a store with key filters, written in two loads by hour."""
    b = _batch(s, d)
    stored = b.where("cast(event_id as bigint) % 3 = 0").select("event_id", F.lit(None).cast("string").alias("idempotency_key"), (F.col("idx") % 24).alias("hour"))
    keys = b.where("cast(substr(idempotency_key, 5) as bigint) % 5 = 0").select(F.lit(None).cast("string").alias("event_id"), "idempotency_key", (F.col("idx") % 24).alias("hour"))
    store = keyindex.EventStore(s, _folder(s, "events"), "hour")
    store.append(stored)
    store.append(keys)
    return store.outcomes(b).select("idx", "outcome")


# ------------------------------------------------------------ stored tables
def _folder(s, what: str) -> str:
    return f"{shared_folder(s)}/{what}-{uuid.uuid4().hex}"


@query(ROLLUP)
def metric_upsert_replayed(s, d):
    """Thirds of the period as batches of a stream, the first one wrong at first and one delivered twice."""
    m = metrics.rollup(metrics.footfall(ev(s, d)), "footfall").withColumn("day", F.to_date("bucket_start"))
    table = versioned.VersionedTable(s, _folder(s, "metrics"), ["store_id", "metric_name", "bucket_start", "granularity"], "day")
    third = F.col("bucket_start") < F.lit(START).cast("timestamp_ntz"), F.col("bucket_start") < F.lit(MIDDLE).cast("timestamp_ntz")
    table.upsert(m.where(third[0]).withColumn("value", F.lit(-1.0)), "footfall", 0)
    table.upsert(m.where(third[1]), "footfall", 1)
    table.upsert(m.where(third[1]).withColumn("value", F.lit(-2.0)), "footfall", 1)
    table.upsert(m.where(~third[1]), "footfall", 2)
    return table.read().drop("day")


@query(f"select store_id, cast(date_trunc('day', occurred_at) as timestamp) as period_start, count(distinct external_track_id) as visitors from ev where event_type = 'vision.zone.entered' and {CUST} and external_track_id is not null group by 1, 2 union all select store_id, null, count(distinct external_track_id) from ev where event_type = 'vision.zone.entered' and {CUST} and external_track_id is not null group by 1")
def visitors_by_period(s, d):
    """From stored bitmaps by hour, written in two batches; no event is read for the days or the whole."""
    e = ev(s, d).where((F.col("event_type") == C.ENTERED) & C.is_customer_event()).select("store_id", C.hour("occurred_at").alias("bucket_start"), F.col("external_track_id").alias("track"))
    first = e.where(F.col("bucket_start") < F.lit(MIDDLE).cast("timestamp_ntz"))
    numbers = settled(bitmaps.numbers_of(first))
    stored = settled(bitmaps.hourly_bitmaps(first, numbers))
    later = e.where(F.col("bucket_start") >= F.lit(MIDDLE).cast("timestamp_ntz"))
    stored = settled(bitmaps.merged_bitmaps(stored, bitmaps.hourly_bitmaps(later, settled(bitmaps.numbers_of(later, numbers)))))
    return bitmaps.visitors_by(stored, "day").union(bitmaps.visitors_by(stored))


@query("select event_id, occurred_at, external_track_id from (select * from ev where store_id = 'store-1' order by occurred_at desc, event_id limit 500 offset 1000)")
def deep_page(s, d):
    table = pages.PagedTable(s, _folder(s, "pages"), "store_id", [("occurred_at", True), ("event_id", False)])
    table.write(ev(s, d))
    return table.page("store-1", 1000, 500).select("event_id", "occurred_at", "external_track_id")


@query(f"with recursive {adapter.SQL}, {BATCH} select 'all' as tally, cast(count(*) as bigint) as events, count(*) filter (event_type <> 'bad.type') as accepted, count(*) filter (event_type = 'bad.type') as rejected, cast(0 as bigint) as duplicate from bt")
def batch_tally(s, d):
    """Events handed over in batches of at most 500 by the sink, and its tallies summed up."""
    batches.register(s)
    folder = _folder(s, "sent")
    status = F.when(F.col("event_type") == "bad.type", "rejected").otherwise("accepted")
    _batch(s, d).withColumn("status", status).write.format("event_batches").mode("append").option("batch_size", 500).save(folder)
    t = s.read.schema("batch string, events long, accepted long, duplicate long, rejected long").json(f"{folder}/tallies")
    return t.agg(F.lit("all").alias("tally"), *(F.sum(c).alias(c) for c in ("events", "accepted", "rejected", "duplicate")))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k, case when try_cast(json_extract_string(props, '$.k') as integer) % 2 = 0 then json_extract_string(props, '$.k') end as even, cast(null as varchar) as missing from events")
def payload_fields(s, d):
    raw = s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("props").alias("payload"))
    e = ingest.parsed(raw).select("event_id", ingest.payload_field("$.k", "int").alias("k"), ingest.payload_field("$.k", "string").alias("even"), ingest.payload_field("$.no", "string").alias("missing"))
    return e.withColumn("even", F.when(F.col("k") % 2 == 0, F.col("even")))


# ------------------------------------------------------------ foot points, zones and lines
def _zone(zid, zone_type, points, **more):
    return {"zone_id": zid, "zone_type": zone_type, "points": [list(p) for p in points], **more}


#: Zones of the queries: several polygons a camera, concave and overlapping ones, a hidden part, lines of a door, and zones that two cameras see.
ZONES = {
    "CAM1": [
        _zone("door", "entry_threshold", [(0.1, 0.5), (0.9, 0.5)], kind="line"), _zone("entrance", "entrance", [(0.2, 0.2), (0.8, 0.25), (0.7, 0.6), (0.25, 0.7)], dedupe_after_zone_types=["entry_threshold"]),
        _zone("mirror", "ignore", [(0.0, 0.9), (0.3, 0.9), (0.3, 1.0), (0.0, 1.0)], exclude_detections=True),
    ],
    "CAM2": [_zone("shelf-a", "browse", [(0.05, 0.05), (0.55, 0.05), (0.55, 0.3), (0.3, 0.3), (0.3, 0.8), (0.05, 0.8)]), _zone("shelf-b", "browse", [(0.5, 0.2), (0.95, 0.5), (0.5, 0.9)]), _zone("walk", "aisle", [(0.0, 0.0), (1.0, 0.0), (1.0, 0.12), (0.0, 0.12)])],
    "CAM3": [
        _zone("island", "promo_island", [(0.5, 0.1), (0.6, 0.4), (0.9, 0.5), (0.6, 0.6), (0.5, 0.9), (0.4, 0.6), (0.1, 0.5), (0.4, 0.4)]),
        _zone("gate", "aisle", [(0.5, 0.0), (0.5, 1.0)], kind="line", direction_normal=[1.0, 0.2]), _zone("count", "aisle", [(0.2, 0.0), (0.2, 1.0)], kind="line", counting_only=True),
    ],
    "CAM4": [_zone("queue", "billing_queue", [(0.1, 0.1), (0.6, 0.1), (0.6, 0.7), (0.1, 0.7)]), _zone("till", "checkout", [(0.4, 0.4), (0.95, 0.4), (0.95, 0.95), (0.4, 0.95)], require_prior_zone_types=["billing_queue"], dedupe_after_zone_types=["consultation"], dedupe_after_seconds=8)],
    "CAM5": [_zone("queue", "billing_queue", [(0.3, 0.0), (1.0, 0.3), (0.3, 0.6)]), _zone("desk", "consultation", [(0.0, 0.5), (0.45, 0.5), (0.45, 1.0), (0.0, 1.0)]), _zone("door", "entry_threshold", [(0.0, 0.3), (1.0, 0.45)], kind="line")],
}


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f"cast({v!r} as double)" if isinstance(v, float) else str(v) if isinstance(v, (int, list)) else f"'{v}'"
    return f"{name}({columns}) as (select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}))"


def _edge_rows(name: str, zones: dict[str, list[dict]], keep, shape=lambda p: p) -> str:
    rows = []
    for cam, zs in zones.items():
        for z in filter(keep, zs):
            p = shape(z["points"])
            rows += [(cam, z["zone_id"], *map(float, (*a, *b))) for a, b in zip(p, [p[-1], *p[:-1]], strict=True)]
    return _values(name, "camera_id, zone_id, ax, ay, zx, zy", rows)


ODD = "count(*) filter ((ay > foot_y) <> (zy > foot_y) and foot_x < (zx - ax) * (foot_y - ay) / (zy - ay + 1e-9) + ax) % 2 = 1"
_is_polygon = lambda z: z.get("kind", "polygon") == "polygon"


@query(f"with recursive {adapter.SQL}, {_edge_rows('ed', ZONES, _is_polygon)} select event_id, store_id, camera_id, zone_id from (select event_id, store_id, camera_id, zone_id, {ODD} as inside from fr join ed using (camera_id) group by 1, 2, 3, 4) where inside")
def zone_membership(s, d):
    polygons = {cam: [z for z in zs if _is_polygon(z)] for cam, zs in ZONES.items()}
    return geometry.zone_membership(adapter.frames(s, d), readers.zones_frame(s, polygons)).select("event_id", "store_id", "camera_id", "zone_id")


def _moves_sql() -> str:
    """The zone machine as a recursion over sights (a frame and a zone) in order: `ms` holds moves."""
    numbered, zone_rows = moves.numbered_zones(ZONES), []
    for cam, zs in numbered.items():
        for z in zs:
            line, at = not _is_polygon(z), lambda names: [z["types"].index(t) + 1 for t in names or ()]  # noqa: B023
            unit = C.line_normal(tuple(z["points"][0]), tuple(z["points"][1]), tuple(z["direction_normal"]) if z.get("direction_normal") else None) if line else (None, None)
            normal = z.get("direction_normal") or unit
            zone_rows.append((
                cam, z["zone_id"], z["zone_type"], z["place"] + 1, len(zs), z["type_place"] + 1, len(z["types"]), line, at(z.get("require_prior_zone_types")), at(z.get("dedupe_after_zone_types")), int(1000 * z.get("dedupe_after_seconds", jobs.AFTER_S)),
                *(float(v) if line else None for v in ((*z["points"][0], *normal, *unit) if line else (None,) * 6)),
            ))
    put = lambda xs, i, v, n: f"[case when k = {i} then {v} else {xs}[k] end for k in range(1, {n} + 1)]"
    return f"""with recursive {adapter.SQL}, {_edge_rows('full_', ZONES, lambda z: _is_polygon(z) and not z.get('exclude_detections'))}, {_edge_rows('core_', ZONES, lambda z: _is_polygon(z) and not z.get('exclude_detections'), lambda p: jobs.shrunk(p, jobs.POLYGON_SLACK))}, {_edge_rows('mask_', ZONES, lambda z: z.get('exclude_detections'))},
{_values('zs', 'camera_id, zone_id, zone_type, place, places, tplace, tplaces, line, prior, later, wait, px, py, nx, ny, ux, uy', zone_rows)},
hidden as (select event_id from (select event_id, zone_id, {ODD} as inside from qf join mask_ using (camera_id) group by 1, 2) where inside),
vis as (select *, epoch_us(ts) // 1000 as at_, lag(foot_x) over w as last_x, lag(foot_y) over w as last_y from qf where event_id not in (select event_id from hidden) window w as (partition by store_id, camera_id, local_track_id order by ts, foot_x, foot_y)),
inn as (select event_id, zone_id, {ODD} as inside from qf join full_ using (camera_id) group by 1, 2), cor as (select event_id, zone_id, {ODD} as inside from qf join core_ using (camera_id) group by 1, 2),
el as (
  select v.store_id, v.camera_id, v.local_track_id, v.at_, z.*exclude (camera_id, px, py, nx, ny, ux, uy), i.inside, c.inside as core,
    case when (foot_x - px) * nx + (foot_y - py) * ny > {jobs.LINE_SLACK} then 1 when (foot_x - px) * nx + (foot_y - py) * ny < -{jobs.LINE_SLACK} then -1 else 0 end as sign,
    coalesce(abs((foot_x - last_x) * ux + (foot_y - last_y) * uy) >= {jobs.LEAST_WAY}, true) as wide,
    row_number() over (partition by v.store_id, v.camera_id, v.local_track_id order by v.ts, v.foot_x, v.foot_y, z.place) as n
  from vis v join zs z on z.camera_id = v.camera_id left join inn i on i.event_id = v.event_id and i.zone_id = z.zone_id left join cor c on c.event_id = v.event_id and c.zone_id = z.zone_id
),
st as (
  select store_id, camera_id, local_track_id, cast(0 as bigint) as n, cast(null as bigint) as at_, cast(null as integer) as place, [cast(null as bigint) for k in range(1, max(places) + 1)] as since, [0 for k in range(1, max(places) + 1)] as side, [cast(null as bigint) for k in range(1, max(places) + 1)] as crossed,
    [cast(null as bigint) for k in range(1, max(tplaces) + 1)] as entered, cast(null as varchar) as kind, cast(null as varchar) as direction, cast(null as bigint) as dwell_ms from el group by 1, 2, 3
  union all
  select store_id, camera_id, local_track_id, n, at_, place,
    {put('since', 'place', 'case when goes then null when comes then at_ else since[k] end', 'places')}, {put('side', 'place', 'case when line and sign <> 0 and (not turned or soon or over_) then sign else side[k] end', 'places')},
    {put('crossed', 'place', 'case when over_ then at_ else crossed[k] end', 'places')}, {put('entered', 'tplace', "case when told or counted then at_ else entered[k] end", 'tplaces')},
    case when told or counted then 'enter' when goes then 'exit' end, case when counted then case when inward then 'in' else 'out' end end, case when goes then at_ - since[place] end
  from (select *, over_ and not (inward and again) as counted, comes and not blocked and not again as told from (
    select *, turned and not soon and wide as over_ from (
    select el.*, st.since, st.side, st.crossed, st.entered,
      not line and st.since[el.place] is not null and not core and el.at_ - st.since[el.place] >= {jobs.LEAST_DWELL_MS} as goes,
      not line and st.since[el.place] is null and inside and (len(prior) = 0 or len([1 for t in prior if st.entered[t] is not null]) > 0) as comes,
      len([1 for t in later if el.at_ - st.entered[t] <= wait]) > 0 as blocked, coalesce(el.at_ - st.entered[tplace] <= {int(1000 * jobs.SAME_TYPE_S)}, false) as again,
      line and st.side[el.place] * sign < 0 as turned, coalesce(el.at_ - st.crossed[el.place] < {int(1000 * jobs.LINE_S)}, false) as soon, sign > st.side[el.place] as inward
    from st join el on el.store_id = st.store_id and el.camera_id = st.camera_id and el.local_track_id = st.local_track_id and el.n = st.n + 1)))
),
ms as (select st.store_id, st.camera_id, st.local_track_id, epoch_ms(st.at_) as ts, zs.zone_id, zs.zone_type, kind, direction, dwell_ms from st join zs on zs.camera_id = st.camera_id and zs.place = st.place where kind is not null)"""


def _moves(s, d):
    return moves.zone_moves(adapter.quick_frames(s, d), ZONES).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(_moves_sql() + " select store_id, camera_id, local_track_id, ts, zone_id, zone_type from ms where kind = 'enter' and direction is null")
def zone_enters(s, d):
    return _moves(s, d).where("kind = 'enter' and direction is null").select("store_id", "camera_id", "local_track_id", "ts", "zone_id", "zone_type")


@query(_moves_sql() + " select store_id, camera_id, local_track_id, ts, zone_id, dwell_ms from ms where kind = 'exit'")
def zone_exits(s, d):
    return _moves(s, d).where("kind = 'exit'").select("store_id", "camera_id", "local_track_id", "ts", "zone_id", "dwell_ms")


@query(_moves_sql() + " select store_id, camera_id, local_track_id, ts, zone_id, direction from ms where direction is not null")
def line_crossings(s, d):
    return _moves(s, d).where("direction is not null").select("store_id", "camera_id", "local_track_id", "ts", "zone_id", "direction")


@query(_moves_sql() + f""",
pe as (select *, row_number() over (partition by store_id, local_track_id, zone_id, direction is null order by ts, camera_id) as n from ms where kind = 'enter'),
db(store_id, local_track_id, zone_id, area, n, ts, told, kept) as (
  select store_id, local_track_id, zone_id, direction is null, n, ts, ts, true from pe where n = 1
  union all
  select pe.store_id, pe.local_track_id, pe.zone_id, db.area, pe.n, pe.ts, case when pe.ts - db.told > to_seconds(case when area then {int(jobs.SAME_TYPE_S)} else {int(jobs.LINE_S)} end) then pe.ts else db.told end, pe.ts - db.told > to_seconds(case when area then {int(jobs.SAME_TYPE_S)} else {int(jobs.LINE_S)} end)
  from db join pe on pe.store_id = db.store_id and pe.local_track_id = db.local_track_id and pe.zone_id = db.zone_id and (pe.direction is null) = db.area and pe.n = db.n + 1
)
select store_id, local_track_id, zone_id, area, count(*) as enters, max(ts) as last_at from db where kept group by 1, 2, 3, 4""")
def person_enters(s, d):
    told = moves.debounced(_moves(s, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("global_id", F.col("local_track_id"))).where("kind = 'enter'")
    return told.groupBy("store_id", "local_track_id", "zone_id", F.col("direction").isNull().alias("area")).agg(F.count("*").alias("enters"), F.max("ts").cast("timestamp_ntz").alias("last_at"))


# ------------------------------------------------------------ dashboard
DASH = f"""with recursive {adapter.SQL}, {HEAT}, hc as ({HEAT_CONF}), ek as ({EVENT_KPIS}), sk as ({SESSION_KPIS}),
tk as (select store_id, cast(sum(case when status = 'completed' then amount else 0 end) as double) as revenue, count(*) filter (status = 'completed') as purchases, count(*) filter (status = 'completed' and external_track_id is not null) as linked from tx group by 1),
da as (
select store_id, greatest(visitors, session_visitors) as visitors, store_entries, store_exits, reentries, queue_enters, customer_sessions as sessions, staff_filtered, purchases, revenue,
  round(least(1.0, linked / cast(greatest(visitors, session_visitors) as double)), 4) as conversion, round(revenue / purchases, 2) as aov, round(linked / cast(purchases as double), 4) as linkage_rate, confidence as heatmap_confidence, weighted_dwell
from ek join sk using (store_id) join tk using (store_id) join hc using (store_id))"""


@query(DASH + " select * from da", name="dashboard")
def dashboard_query(s, d):
    return dashboard.dashboard(ev(s, d), tx(s, d))


@query(DASH + " select store_id, unnest(['sessions', 'conversion_rate', 'revenue', 'average_basket_value', 'queue_depth']) as kpi, unnest([cast(sessions as varchar), printf('%.1f%%', conversion * 100), '₹' || format('{:,.2f}', revenue), '₹' || format('{:,.2f}', aov), cast(queue_enters as varchar)]) as text from da")
def kpi_texts(s, d):
    return dashboard.kpi_texts(dashboard.dashboard(ev(s, d), tx(s, d)))


def _proof(s, d):
    e, t = ev(s, d), tx(s, d)
    ses = _sessions(s, d, True)
    return dashboard.reviewer_proof(
        metrics.coverage(e, "2000-01-01 00:00:00", "2100-01-01 00:00:00", VIDEOS).select("store_id", "n_videos"), metrics.event_kpis(e, ses), metrics.session_kpis(ses), metrics.sales_kpis(t), _funnel(s, d), zones.heatmap_confidence(zones.heatmap(e))
    )


PROOF = f"""{WITH_SIG}, {HEAT}, hc as ({HEAT_CONF}), ek as ({EVENT_KPIS}), sk as ({SESSION_KPIS}),
ff as (select store_id, max(case when stage = 'ENTRY' then visitors end) as fe, max(case when stage = 'BILLING_QUEUE' then visitors end) as fb, max(case when stage = 'PURCHASE' then visitors end) as fp, count(*) as stages, sum(reentries) as again from fu group by 1),
vv as (select store_id, count(distinct source_video) + count(distinct case when camera_id = 'CAM5' then camera_id end) as n from ev group by 1),
ll as (select store_id, count(*) filter (status = 'completed' and external_track_id is not null) as linked from tx group by 1),
pp as (
  select store_id, unnest(['5 CCTV videos processed', 'Vision events generated', 'Entries detected', 'Exits detected', 'Re-entry tracking', 'Conversion logic', 'Funnel engine', 'Heatmap zones']) as name,
    unnest([n >= 5, events > 0, greatest(store_entries, fe, customer_sessions) > 0, greatest(store_exits, session_exits) > 0, again > 0, greatest(store_entries, fe, customer_sessions) > 0 and fp <= greatest(store_entries, fe, customer_sessions) and (linked > 0 or fb > 0), stages >= 4, zones > 0 and zone_visits > 0]) as passed
  from vv join ek using (store_id) join sk using (store_id) join ff using (store_id) join hc using (store_id) left join ll using (store_id)
)"""


@query(PROOF + " select * from pp")
def reviewer_proof(s, d):
    return _proof(s, d)


@query(PROOF + " select store_id, count(*) filter (passed) as checks_passed, count(*) as checks_total, count(*) filter (passed) >= 6 as ready from pp group by 1")
def ready_for_review(s, d):
    return dashboard.ready_for_review(_proof(s, d))


_BOX = {"any": [_zone("box", "browse", [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9)])]}


@query(f"with recursive {adapter.SQL}, {_edge_rows('ed', _BOX, _is_polygon)} select event_id, {ODD} as inside from fr cross join ed group by 1")
def point_in_zone(s, d):
    z = readers.zones_frame(s, _BOX)  # one row
    return adapter.frames(s, d).crossJoin(F.broadcast(z.select("points"))).select("event_id", C.in_polygon("foot_x", "foot_y", "points").alias("inside"))


def queries() -> dict[str, Query]:
    from . import rule_queries  # noqa: F401  registers its queries

    return {n: f for n, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    from . import rule_queries  # noqa: F401

    return {n: sql for n, (_, sql) in _FOUND.items() if sql is not None}
