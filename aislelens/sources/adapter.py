"""The retail tables as views of the star-schema tables that tests and benchmarks run on.

Fixed mapping: a user is a track, an event type a kind of vision event, a line item a till line.
Orders are spread over the days of the events by their key, so that the two can be linked.
Every other operator sees only what these functions return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01 in microseconds.
START_US = 1_704_067_200_000_000
CAMERAS = ["CAM1", "CAM2", "CAM3", "CAM4", "CAM5"]


def _k() -> Column:
    """Unreadable props count as 0."""
    return F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))


def _track(user: str, ts: str) -> Column:
    """A user's day is a track: few users as there are, tracks differ in the stages they reach."""
    return F.concat(F.col(user).cast("string"), F.lit("-"), F.date_format(ts, "MMdd"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed vision and purchase events: what the silver layer holds, one row an event."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", _k())
    kind, k = F.col("event_type"), F.col("k")
    zone = (
        F.when(kind == "signup", "entry_threshold")
        .when((kind == "view") & (k % 3 == 0), "browse_skincare")
        .when((kind == "view") & (k % 5 == 4), "aisle")
        .when(kind == "view", "browse")
        .when(kind == "click", "billing_queue")
        .when((kind == "error") & (k % 10 == 9), "staff_only")
        .when(kind == "error", "browse")
    )
    return raw.select(
        F.col("event_id"),
        F.concat(F.lit("store-"), F.col("user_id") % 3).alias("store_id"),
        F.when(kind == "purchase", "analytics.purchase.completed").when(kind == "error", "vision.zone.exited").otherwise("vision.zone.entered").alias("event_type"),
        F.col("ts").alias("occurred_at"),
        _track("user_id", "ts").alias("external_track_id"),
        F.when(F.col("user_id") % 50 == 0, "staff").otherwise("visitor").alias("class_label"),
        zone.alias("zone_type"),
        F.when(zone.isNotNull() & (k % 10 != 3), F.concat(F.lit("zone-"), k % 10)).alias("zone_id"),
        F.element_at(F.array(*map(F.lit, CAMERAS)), k % 5 + 1).alias("camera_id"),
        F.when(kind == "error", F.col("value") * 1000).alias("dwell_ms"),
        (k % 7 == 0).alias("is_reentry"),
        ((kind == "signup") & (k % 2 == 0)).alias("is_store_entry"),
        ((kind == "error") & (k % 4 == 0)).alias("is_store_exit"),
        F.when(k % 2 == 0, "mock").otherwise("yolo").alias("detector_mode"),
        F.concat(F.lit("/videos/"), F.element_at(F.array(*map(F.lit, CAMERAS)), k % 5 + 1), F.lit(".mp4")).alias("source_video"),
        F.col("k").alias("frame_index"),
        F.col("value"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(o_orderkey * 7919 % 2592000 as decimal(18, 6)))"))
    o = o.withColumn("user", F.col("o_custkey") % 150)
    linked = F.col("o_custkey") % 2 == 0
    return o.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.concat(F.lit("store-"), F.col("o_custkey") % 3).alias("store_id"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"),
        F.col("at").alias("occurred_at"),
        F.when(linked, _track("user", "at")).alias("external_track_id"),
        F.when(linked & (F.col("o_orderkey") % 3 != 0), "TIME_WINDOW").alias("link_method"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of frames as a tracker would give them: one row a person and frame, a frame being an hour of a camera."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", _k())
    y = (F.col("event_id") * 37 % 100) / 100
    return raw.select(
        "event_id", F.concat(F.lit("store-"), F.col("user_id") % 3).alias("store_id"), F.element_at(F.array(*map(F.lit, CAMERAS)), F.col("k") % 5 + 1).alias("camera_id"),
        F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("frame_index"), F.col("ts"), F.col("user_id").alias("local_track_id"), _track("user_id", "ts").alias("global_id"),
        (F.col("k") / 100).alias("foot_x"), y.alias("foot_y"), (0.5 + F.col("k") / 200).alias("confidence"), (F.col("user_id") % 50 == 0).alias("is_staff"),
    )


def quick_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames() at 36,000 times the speed, so that a track's frames are seconds apart."""
    return frames(spark, sf_dir).withColumn("ts", F.timestamp_micros(F.expr(f"{START_US} + (unix_micros(cast(ts as timestamp)) - {START_US}) div 36000")))


def pos_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("p_brand").alias("brand_name"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("gmv"),
        (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5) / 100).cast("decimal(12,2)").alias("nmv"),
        F.col("l_shipdate").alias("shipped_at"),
    )


#: The same views in DuckDB, as common table expressions.
SQL = """
ev as (
  select event_id, 'store-' || (user_id % 3) as store_id,
    case event_type when 'purchase' then 'analytics.purchase.completed' when 'error' then 'vision.zone.exited' else 'vision.zone.entered' end as event_type,
    ts as occurred_at, user_id || '-' || strftime(ts, '%m%d') as external_track_id,
    case when user_id % 50 = 0 then 'staff' else 'visitor' end as class_label,
    case when event_type = 'signup' then 'entry_threshold' when event_type = 'view' and k % 3 = 0 then 'browse_skincare' when event_type = 'view' and k % 5 = 4 then 'aisle' when event_type = 'view' then 'browse'
         when event_type = 'click' then 'billing_queue' when event_type = 'error' and k % 10 = 9 then 'staff_only' when event_type = 'error' then 'browse' end as zone_type,
    case when event_type <> 'purchase' and k % 10 <> 3 then 'zone-' || (k % 10) end as zone_id,
    'CAM' || (k % 5 + 1) as camera_id, case when event_type = 'error' then value * 1000 end as dwell_ms,
    k % 7 = 0 as is_reentry, event_type = 'signup' and k % 2 = 0 as is_store_entry, event_type = 'error' and k % 4 = 0 as is_store_exit,
    case when k % 2 = 0 then 'mock' else 'yolo' end as detector_mode, '/videos/CAM' || (k % 5 + 1) || '.mp4' as source_video, k as frame_index, value
  from (select *, coalesce(try_cast(json_extract_string(props, '$.k') as integer), 0) as k from events)
),
tx as (
  select o_orderkey as transaction_id, 'store-' || (o_custkey % 3) as store_id, cast(o_totalprice as decimal(12,2)) as amount,
    case when o_orderstatus = 'F' then 'completed' else 'pending' end as status, sold_at as occurred_at,
    case when o_custkey % 2 = 0 then (o_custkey % 150) || '-' || strftime(sold_at, '%m%d') end as external_track_id,
    case when o_custkey % 2 = 0 and o_orderkey % 3 <> 0 then 'TIME_WINDOW' end as link_method
  from (select *, timestamp '2024-01-01 00:00:00' + to_seconds(o_orderkey * 7919 % 2592000) as sold_at from orders)
),
fr as (
  select event_id, 'store-' || (user_id % 3) as store_id, 'CAM' || (k % 5 + 1) as camera_id, cast(floor(epoch(ts) / 3600) as bigint) as frame_index, ts, user_id as local_track_id,
    user_id || '-' || strftime(ts, '%m%d') as global_id, k / 100 as foot_x, (event_id * 37 % 100) / 100 as foot_y, 0.5 + k / 200 as confidence, user_id % 50 = 0 as is_staff
  from (select *, coalesce(try_cast(json_extract_string(props, '$.k') as integer), 0) as k from events)
),
qf as (select * replace (make_timestamp(1704067200000000 + cast(floor((epoch_us(ts) - 1704067200000000) / 36000) as bigint)) as ts) from fr),
pos as (
  select l_orderkey as order_id, l_linenumber as line_no, p_brand as brand_name, p_type as category, cast(trunc(l_quantity) as integer) as qty,
    cast(l_extendedprice as decimal(12,2)) as gmv, cast(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 as decimal(12,2)) as nmv, l_shipdate as shipped_at
  from lineitem join part on l_partkey = p_partkey
),
vi as (
  select external_track_id, store_id, sess, min(occurred_at) as started_at, max(occurred_at) as ended_at, count(*) as n_events
  from (
    select *, sum(case when gap is null or gap > 1800 then 1 else 0 end) over (partition by store_id, external_track_id order by occurred_at, event_id rows unbounded preceding) as sess
    from (select *, epoch_us(occurred_at) / 1e6 - epoch_us(lag(occurred_at) over (partition by store_id, external_track_id order by occurred_at, event_id)) / 1e6 as gap from ev where event_type like 'vision.%')
  ) group by external_track_id, store_id, sess
),
se as (
  select store_id, external_track_id, min(occurred_at) as started_at, coalesce(max(case when event_type = 'vision.track.ended' then occurred_at end), max(occurred_at)) as ended_at,
    case when bool_or(event_type = 'vision.track.ended') then 'completed' else 'active' end as status, count(*) as n_events,
    bool_or(lower(coalesce(class_label, '')) = 'staff' or lower(coalesce(zone_type, '')) in ('staff_only', 'ignore')) as staff,
    bool_or(event_type = 'vision.zone.entered' and (is_store_entry or lower(coalesce(zone_type, '')) in ('entry_threshold', 'entrance', 'entry') or (lower(coalesce(class_label, '')) <> 'staff' and lower(coalesce(zone_type, '')) not in ('staff_only', 'ignore')))) as store_entry
  from ev where event_type in ('vision.zone.entered', 'vision.zone.exited', 'vision.track.ended') and external_track_id is not null and external_track_id <> '' group by 1, 2
)"""
