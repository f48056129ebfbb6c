"""Queries of single rules over whole tables: geometry of detections, till parsing, keys and links of sessions, listings, exports, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import columns as C
from .operators import identity, metrics, sales, visits
from .queries import CUST, MIDDLE, VIS, ZONES, _edge_rows, _folder, ev, query, tx  # noqa: F401  (the SQL below is built of these)
from .sources import adapter, readers, versioned
from .streaming import events, jobs, tracking

A, B, NORMAL = (0.1, 0.4), (0.9, 0.6), (0.3, 1.0)
STORES = "st as (select distinct 'store-' || (c_custkey % 5) as store_id from customer)"
#: Sessions and what names them: a track is a session, of every second event the session is named, of some a session that nobody knows.
SESSIONS = "ss as (select store_id, store_id || '/' || external_track_id as session_id, external_track_id, started_at, staff from se)"
NAMED_EVENTS = (
    "ne as (select *, case when event_id % 7 = 0 then 'lost-' || (event_id % 50) when event_id % 2 = 0 then store_id || '/' || external_track_id end as session_id, "
    "case when event_id % 3 = 0 then null else external_track_id end as own_track from ev)"
)


def _stores(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("store-"), F.col("c_custkey") % 5).alias("store_id")).distinct()


def _sessions(s, d):
    x = visits.materialize_sessions(ev(s, d), keep_staff=True)
    return x.select("store_id", F.concat_ws("/", "store_id", "external_track_id").alias("session_id"), "external_track_id", "started_at", "staff", "status")


def _named(s, d):
    e, i = ev(s, d), F.col("event_id")
    session = F.when(i % 7 == 0, F.concat(F.lit("lost-"), i % 50)).when(i % 2 == 0, F.concat_ws("/", "store_id", "external_track_id"))
    return e.withColumn("session_id", session).withColumn("external_track_id", F.when(i % 3 != 0, F.col("external_track_id")))


# ------------------------------------------------------------ geometry of detections
@query("""select event_id, x + w / 2 as foot_x, y + h as foot_y, h >= 0.08 and w * h between 0.002 and 0.2 and h / w between 1.2 and 5.5 and confidence >= 0.55 as ok,
  greatest(0.0, least(1.0, (px - pw / 2) / 1920)) as left_, greatest(0.0, least(1.0, ph / 1080)) as height
from (select *, foot_x * 0.8 as x, foot_y * 0.7 as y, 0.02 + foot_y / 10 as w, 0.05 + foot_x / 4 as h, foot_x * 1920 as px, 60 + foot_y * 300 as pw, 90 + foot_x * 1200 as ph from fr)""")
def detection_boxes(s, d):
    """Foot points, quality and pixels to shares of detections. (F-01, P-19, P-20)"""
    x, y = F.col("foot_x"), F.col("foot_y")
    f = adapter.frames(s, d).withColumn("bbox", F.struct((x * 0.8).alias("x"), (y * 0.7).alias("y"), (F.lit(0.02) + y / 10).alias("w"), (F.lit(0.05) + x / 4).alias("h")))
    f = f.withColumn("px", x * 1920).withColumn("py", y * 1080).withColumn("pw", F.lit(60) + y * 300).withColumn("ph", F.lit(90) + x * 1200)
    box = C.top_left("px", "py", "pw", "ph", 1920, 1080)
    return f.select("event_id", C.foot_point("bbox").alias("p"), C.detection_ok(0.08, 0.002, 0.2, 0.55).alias("ok"), box.alias("b")).select("event_id", F.col("p.x").alias("foot_x"), F.col("p.y").alias("foot_y"), "ok", F.col("b.x").alias("left_"), F.col("b.h").alias("height"))


_UNIT = C.line_normal(A, B)


@query(f"""select event_id, own, given, case when own > 0.008 then 1 when own < -0.008 then -1 else 0 end as side from (
  select event_id, (foot_x - {A[0]}) * {_UNIT[0]!r} + (foot_y - {A[1]}) * {_UNIT[1]!r} as own, (foot_x - {A[0]}) * {NORMAL[0]} + (foot_y - {A[1]}) * {NORMAL[1]} as given from fr)""")
def line_sides(s, d):
    """(F-03, F-04)"""
    f = adapter.frames(s, d).select("event_id", C.line_side("foot_x", "foot_y", A, B).alias("own"), C.line_side("foot_x", "foot_y", A, B, NORMAL).alias("given"))
    return f.withColumn("side", C.side_sign(F.col("own"), jobs.LINE_SLACK))


_SHELF = {"CAM2": [z for z in ZONES["CAM2"] if z["zone_id"] == "shelf-a"]}


@query(f"with recursive {adapter.SQL}, {_edge_rows('ed', _SHELF, lambda z: True, lambda p: jobs.shrunk(p, 0.25))} select event_id from (select event_id, count(*) filter ((ay > foot_y) <> (zy > foot_y) and foot_x < (zx - ax) * (foot_y - ay) / (zy - ay + 1e-9) + ax) % 2 = 1 as inside from fr join ed using (camera_id) group by 1) where inside")
def well_inside(s, d):
    """Foot points in a zone drawn in by a quarter. (F-05)"""
    zone = readers.zones_frame(s, _SHELF).select("camera_id", C.scaled_polygon("points", 0.75).alias("points"))
    return adapter.frames(s, d).join(zone, "camera_id").where(C.in_polygon("foot_x", "foot_y", "points")).select("event_id")


@query("""with v as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null),
m as (select a.vec_id, list_transform(list_zip(a.e, b.e), lambda t: t[1] * (1 - 0.35) + t[2] * 0.35) as mixed from v a join v b on b.vec_id = a.vec_id + 1),
n as (select vec_id, mixed, sqrt(list_sum(list_transform(mixed, lambda x: x * x))) as n from m)
select vec_id, round(mixed[1] / n, 9) as first_, round(mixed[64] / n, 9) as last_ from n""")
def blended_embeddings(s, d):
    """Each vector moved towards the next one. (F-07)"""
    v = s.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("old"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("old").alias("new")), "vec_id").select("vec_id", C.blended("old", "new", 0.35).alias("e"))
    return both.select("vec_id", F.round(F.element_at("e", 1), 9).alias("first_"), F.round(F.element_at("e", 64), 9).alias("last_"))


@query("""select event_id, alike >= 0.5 as likely, 0.55 * greatest(0.0, alike) + 0.2 * greatest(0.0, 1 - gap / 150.0) + 0.15 * graph + 0.1 * alike as score,
  case when 0.55 * greatest(0.0, alike) + 0.2 * greatest(0.0, 1 - gap / 150.0) + 0.15 * graph + 0.1 * alike >= 0.68 then 'appearance+camera_graph+time' else 'p0_solo_handoff' end as method
from (select event_id, foot_x as alike, foot_y * 300 as gap, case when camera_id = 'CAM1' then 1.0 when camera_id = 'CAM2' then 0.45 else 0.3 end as graph from fr)""")
def handoff_scores(s, d):
    """(F-23, F-24)"""
    graph = F.when(F.col("camera_id") == "CAM1", C.ON_EDGE).when(F.col("camera_id") == "CAM2", C.SAME_CAMERA).otherwise(C.OFF_EDGE)
    f = adapter.frames(s, d).select("event_id", F.col("foot_x").alias("alike"), (F.col("foot_y") * 300).alias("gap"), graph.alias("graph"))
    f = f.withColumn("score", C.match_score("alike", "gap", F.lit(150.0), "graph", "alike"))
    return f.select("event_id", (F.col("alike") >= 0.5).alias("likely"), "score", C.handoff_reason("score")["method"].alias("method"))


# ------------------------------------------------------------ till export
POS_TEXT = """
raw as (
  select l_orderkey as order_id, l_linenumber as line_no, 'shop-' || (l_suppkey % 3) as store_id, case when l_linenumber = 3 then 'RETURN' when l_linenumber % 2 = 0 then 'Sales' else 'SALES' end as invoice_type,
    case when l_quantity < 3 then '' when l_quantity > 48 then 'n/a' else cast(cast(l_quantity as integer) as varchar) || '.9' end as qty, case when l_tax > 0.07 then ' ' else cast(cast(l_extendedprice as decimal(12,2)) as varchar) end as gmv,
    case when l_discount = 0 then null else '  ' || l_returnflag || ' ' end as brand, strftime(l_shipdate, '%d-%m-%Y') as day, case when l_linenumber = 5 then '99:00:00' else '10:' || lpad(cast(l_partkey % 60 as varchar), 2, '0') || ':07' end as clock
  from lineitem
)"""


@query(f"""with {POS_TEXT}
select order_id, line_no, case when qty in ('', 'n/a') then 0 else cast(floor(cast(qty as double)) as integer) end as qty, cast(case when trim(gmv) = '' then 0 else cast(gmv as decimal(18,4)) end as double) as gmv,
  coalesce(trim(brand), 'Unknown') as brand_name, 'unknown/unknown' as category, try_strptime(day || ' ' || clock, '%d-%m-%Y %H:%M:%S') as occurred_at
from raw where store_id = 'shop-1' and invoice_type <> 'RETURN'""")
def pos_parsed(s, d):
    """Sale lines of a store from a till export's text. (P-16, F-09..F-11)"""
    n = F.col("l_linenumber")
    qty = F.when(F.col("l_quantity") < 3, "").when(F.col("l_quantity") > 48, "n/a").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".9")))
    gmv = F.when(F.col("l_tax") > 0.07, " ").otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    raw = s.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("order_id"), n.alias("line_no"), F.concat(F.lit("shop-"), F.col("l_suppkey") % 3).alias("store_id"), F.when(n == 3, "RETURN").when(n % 2 == 0, "Sales").otherwise("SALES").alias("invoice_type"), qty.alias("qty"), gmv.alias("GMV"),
        gmv.alias("NMV"), gmv.alias("total_amount"), F.when(F.col("l_discount") != 0, F.concat(F.lit("  "), "l_returnflag", F.lit(" "))).alias("brand_name"), F.lit("").alias("dep_name"), F.lit(None).cast("string").alias("sub_category"),
        F.date_format("l_shipdate", "dd-MM-yyyy").alias("order_date"), F.when(n == 5, "99:00:00").otherwise(F.concat(F.lit("10:"), F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0"), F.lit(":07"))).alias("order_time"),
        *(F.lit("").alias(c) for c in ("invoice_number", "customer_name", "offer_name")),
    )
    return sales.parse_pos(raw, "shop-1").select("order_id", "line_no", "qty", F.col("gmv").cast("double").alias("gmv"), "brand_name", "category", "occurred_at")


@query(f"with {POS_TEXT} select count(*) as line_count, count(distinct order_id) as order_count, 5 as all_columns, 3 as transaction_columns, 1 as revenue_columns, 1 as product_columns, 0 as time_columns from raw")
def pos_columns(s, d):
    """(A-30)"""
    raw = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("order_id"), F.lit("x").alias("store_id"), F.col("l_quantity").cast("string").alias("qty"), F.col("l_extendedprice").cast("string").alias("GMV"), F.col("l_returnflag").alias("brand_name"))
    return sales.column_profile(raw)


# ------------------------------------------------------------ sessions
@query(f"""with recursive {adapter.SQL}, {SESSIONS}, {NAMED_EVENTS}
select event_id, case when ne.session_id is not null then 'track:' || ss.external_track_id else 'track:' || own_track end as visitor_key, coalesce(own_track, ss.external_track_id) as linked_track
from ne left join ss on ss.store_id = ne.store_id and ss.session_id = ne.session_id where case when ne.session_id is not null then not ss.staff else own_track is not null end""")
def visitor_keys(s, d):
    """Events and the visitor they count for, by session or by track. (J-01, J-02)"""
    return visits._keyed(_named(s, d), _sessions(s, d)).select("event_id", "visitor_key", "linked_track")


@query(f"with recursive {adapter.SQL}, {SESSIONS}, {NAMED_EVENTS}, pe as (select * from ss where started_at >= timestamp '{MIDDLE}') select distinct store_id, session_id from ne where session_id is not null and not exists (select 1 from pe where pe.store_id = ne.store_id and pe.session_id = ne.session_id)")
def missing_sessions(s, d):
    """(U-03)"""
    period = _sessions(s, d).where(F.col("started_at") >= F.lit(MIDDLE).cast("timestamp_ntz"))
    none = tx(s, d).where("false").select("store_id", F.lit(None).cast("string").alias("session_id"))
    return visits.missing_sessions(_named(s, d), none, period)


@query(f"with recursive {adapter.SQL}, {SESSIONS}, {NAMED_EVENTS} select store_id, session_id, started_at, staff from ss where exists (select 1 from ne where ne.store_id = ss.store_id and ne.session_id = ss.session_id)")
def named_sessions(s, d):
    """(J-15)"""
    return visits.sessions_by_id(_sessions(s, d), _named(s, d).where("session_id is not null")).select("store_id", "session_id", "started_at", "staff")


@query(f"with recursive {adapter.SQL}, {SESSIONS} select store_id, session_id from ss where store_id = 'store-1' and external_track_id = (select max(external_track_id) from ss where store_id = 'store-1')")
def active_session(s, d):
    """(S-21)"""
    x = _sessions(s, d)
    last = x.where("store_id = 'store-1'").agg(F.max("external_track_id")).first()[0]
    return readers.active_session(x, "store-1", last).select("store_id", "session_id")


@query(f"with recursive {adapter.SQL}, {SESSIONS} select store_id, split_part(external_track_id, '-', 1) as external_track_id, max_by(session_id, (started_at, session_id)) as session_id from ss group by 1, 2")
def sessions_by_track(s, d):
    """The latest session of each user. (S-22)"""
    return sales.latest_session_by_track(_sessions(s, d).withColumn("external_track_id", F.substring_index("external_track_id", "-", 1)))


@query(f"""with recursive {adapter.SQL}, ln as (select store_id, transaction_id % 500 as order_id, max_by(external_track_id, (occurred_at, transaction_id)) as linked from tx where external_track_id is not null group by 1, 2)
select event_id, coalesce(linked, external_track_id) as external_track_id from (select *, event_id % 500 as order_id from ev where event_type = 'analytics.purchase.completed') p left join ln using (store_id, order_id)""")
def purchases_with_tracks(s, d):
    """Purchase events take the track of their order's last link. (J-13, K-09)"""
    purchases = ev(s, d).where(F.col("event_type") == C.PURCHASE).withColumn("order_id", F.col("event_id") % 500)
    links = tx(s, d).withColumn("order_id", F.col("transaction_id") % 500).withColumn("occurred_at", F.struct("occurred_at", "transaction_id"))
    return sales.backfill_tracks(purchases, links).select("event_id", "external_track_id")


# ------------------------------------------------------------ listings, loads, exports
ANOMALIES = """an as (
  select store_id || strftime(occurred_at, '-%m-%d') as anomaly_id, store_id, max(occurred_at) as detected_at, case when count(*) % 3 = 0 then 'CRITICAL' else 'WARN' end as severity, case when count(*) % 2 = 0 then max(occurred_at) end as resolved_at from ev group by 1, 2
)"""


@query(f"with recursive {adapter.SQL}, {ANOMALIES} select anomaly_id, detected_at, severity from an where store_id = 'store-1' and severity = 'WARN' and resolved_at is null and detected_at >= timestamp '2024-01-05 00:00:00' order by detected_at desc, anomaly_id limit 500")
def open_anomalies(s, d):
    """(S-14)"""
    n, at = F.count("*"), F.max("occurred_at")
    an = ev(s, d).groupBy(F.concat("store_id", F.date_format("occurred_at", "-MM-dd")).alias("anomaly_id"), "store_id").agg(at.alias("detected_at"), F.when(n % 3 == 0, "CRITICAL").otherwise("WARN").alias("severity"), F.when(n % 2 == 0, at).alias("resolved_at"))
    return readers.list_anomalies(an, "store-1", "WARN", True, "2024-01-05 00:00:00").select("anomaly_id", "detected_at", "severity")


@query("""select path, camera_id, coalesce(row_number() over (partition by camera_id order by path) = 1 and camera_id is not null, false) as target from (
  select path, case when regexp_replace(lower(regexp_replace(stem, '\\.[^.]*$', '')), '[\\s_\\-.]+', '', 'g') in ('cam1', 'cam2', 'cam3', 'cam4') then upper(regexp_replace(lower(regexp_replace(stem, '\\.[^.]*$', '')), '[\\s_\\-.]+', '', 'g')) end as camera_id
  from (select distinct '/in/' || p as path, p as stem from (select replace(replace(replace(source_video, '/videos/', ''), 'CAM', case frame_index % 3 when 0 then 'CAM ' when 1 then 'cam_' else 'Cam-' end), '.mp4', case when frame_index % 2 = 0 then '.mp4' else '.MKV' end) as p from ev)))""")
def matched_videos(s, d):
    """Files of the events' videos under other spellings, and the cameras they are of. (S-17)"""
    k = F.col("frame_index")
    spelt = F.when(k % 3 == 0, "CAM ").when(k % 3 == 1, "cam_").otherwise("Cam-")
    name = F.concat(F.lit("/in/"), spelt, F.regexp_extract("source_video", "CAM(\\d)", 1), F.when(k % 2 == 0, ".mp4").otherwise(".MKV"))
    cameras = ev(s, d).where("camera_id <> 'CAM5'").select("camera_id", F.col("camera_id").alias("name"), F.col("source_video").alias("video")).distinct()
    return readers.match_videos(ev(s, d).select(name.alias("path")).distinct(), cameras)


@query("""with recursive """ + adapter.SQL + """, ba as (select store_id, case when transaction_id % 10 <> 0 then 'ref-' || (transaction_id % 4000) end as external_ref, transaction_id as load_no from tx)
select store_id, external_ref, min(load_no) as load_no from ba where external_ref is not null and not exists (select 1 from ba o where o.store_id = ba.store_id and o.external_ref = ba.external_ref and o.load_no % 5 = 0) group by 1, 2
union all select store_id, external_ref, load_no from ba where external_ref is null""")
def new_transactions(s, d):
    """(K-02)"""
    i = F.col("transaction_id")
    batch = tx(s, d).select("store_id", F.when(i % 10 != 0, F.concat(F.lit("ref-"), i % 4000)).alias("external_ref"), i.alias("load_no"))
    return readers.new_transactions(batch, batch.where("load_no % 5 = 0 and external_ref is not null"))


@query(f"""select cast(event_id as varchar) as event_id, event_type || '-' || external_track_id || coalesce('-' || zone_id, '') || '-' || (epoch_us(occurred_at) // 1000) as idempotency_key, zone_id, frame_index as frame, 'CAM' || right(camera_id, 1) || '.mp4' as video
from ev where store_id = 'store-2' and {VIS} and detector_mode <> 'mock'""")
def exported_events(s, d):
    """(K-11)"""
    e = readers.exported(ev(s, d), "store-2", drop_mock=True)
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return e.select("event_id", "idempotency_key", get("zone_id").alias("zone_id"), get("frame_index").cast("int").alias("frame"), get("source_video").alias("video"))


# ------------------------------------------------------------ times, flags, numbers
@query("select event_id, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(occurred_at) % 1000000 <> 0 then '.' || lpad(cast(epoch_us(occurred_at) % 1000000 as varchar), 6, '0') else '' end || 'Z' as written, occurred_at as read_again, coalesce(epoch_us(occurred_at) % 1000000 <> 0, false) as fraction from ev")
def iso_times(s, d):
    """(F-12, F-21)"""
    e = ev(s, d).select("event_id", C.iso_utc("occurred_at").alias("written"))
    return e.select("event_id", "written", C.from_iso("written").alias("read_again"), F.col("written").contains(".").alias("fraction"))


@query("""select event_id, coalesce(dir_ = 'in' and zone_type in ('entry_threshold', 'entrance'), false) as entry, zone_type in ('browse', 'aisle') or coalesce(zone_type = 'billing_queue' and is_reentry, false) as meets, k
from (select ev.*, case when is_reentry then 'in' when frame_index % 2 = 0 then 'out' end as dir_, try_cast(json_extract_string(r.props, '$.k') as integer) as k from ev join events r using (event_id)) where zone_type is not null""")
def event_flags(s, d):
    """Store entries, meeting zone types, numbers in JSON. (P-22, U-06, F-16)"""
    props = s.read.parquet(f"{d}/events.parquet").select("event_id", "props")
    e = ev(s, d).where("zone_type is not null").withColumn("direction", F.when(F.col("is_reentry"), "in").when(F.col("frame_index") % 2 == 0, "out")).join(props, "event_id")
    after = F.when(F.col("is_reentry"), F.array(F.lit("browse"), F.lit("aisle"), F.lit("billing_queue"))).otherwise(F.array(F.lit("browse"), F.lit("aisle")))
    e = e.withColumn("emitted", F.array("zone_type")).withColumn("after", after)
    return e.select("event_id", C.store_entry("direction", "zone_type").alias("entry"), identity.shared_zone_types("emitted", "after").alias("meets"), C.json_int("props", "k").alias("k"))


# ------------------------------------------------------------ audits
@query(f"with recursive {adapter.SQL}, ca as (select external_track_id, bool_or(class_label = 'staff') as expected, bool_or(zone_type = 'staff_only') as legacy, bool_or(class_label = 'staff' and event_type like 'vision.%') as improved from ev where external_track_id is not null group by 1) select count(*) filter (legacy) as legacy_detected, count(*) filter (improved) as improved_detected, count(*) filter (expected and not coalesce(legacy, false)) as legacy_contamination, count(*) filter (expected and not improved) as improved_contamination from ca")
def staff_contamination(s, d):
    """(A-55)"""
    no = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    staff = F.col("class_label") == "staff"
    cases = ev(s, d).where("external_track_id is not null").groupBy("external_track_id").agg(no(staff).alias("expected_staff"), no(F.col("zone_type") == "staff_only").alias("legacy_staff"), no(staff & F.col("event_type").startswith("vision.")).alias("improved_staff"))
    return metrics.contamination(cases)


@query(f"""with recursive {adapter.SQL}, tr as (select 'visitors:' || store_id as kpi, cast(count(distinct external_track_id) as bigint) as truth from ev where event_type = 'vision.zone.entered' and {CUST} group by 1 union all select 'purchases:' || store_id, count(*) from tx where status = 'completed' group by 1),
en as (select 'visitors:' || store_id as kpi, cast(count(*) as bigint) as engine from se where not staff group by 1 union all select 'purchases:' || store_id, count(*) filter (event_type = 'analytics.purchase.completed') from ev group by 1 union all select 'more', 1)
select kpi, truth, engine, truth is not distinct from engine as match from tr full join en using (kpi)""")
def kpi_agreement(s, d):
    """Visitors and purchases counted in two ways. (A-64)"""
    named = lambda df, what: df.groupBy(F.concat(F.lit(f"{what}:"), "store_id").alias("kpi"))
    e, t = ev(s, d), tx(s, d)
    truth = named(e.where((F.col("event_type") == C.ENTERED) & C.is_customer_event()), "visitors").agg(F.countDistinct("external_track_id").alias("value")).unionByName(named(t.where("status = 'completed'"), "purchases").agg(F.count("*").alias("value")))
    engine = named(_sessions(s, d).where("not staff"), "visitors").agg(F.count("*").alias("value")).unionByName(named(e, "purchases").agg(F.count_if(F.col("event_type") == C.PURCHASE).alias("value"))).unionByName(s.range(1).select(F.lit("more").alias("kpi"), F.lit(1).cast("long").alias("value")))
    return metrics.kpi_audit(truth, engine)


@query(f"""with recursive {adapter.SQL}, {STORES}, fi as (select store_id, min(occurred_at) as at_ from (select store_id, occurred_at from ev union all select store_id, occurred_at from tx) group by 1)
select st.store_id, coalesce(at_, timestamp '2024-02-01 00:00:00' - interval 24 hour) as period_start, timestamp '2024-02-01 00:00:00' as period_end from st left join fi using (store_id)""")
def store_periods(s, d):
    """(P-06)"""
    return metrics.analysis_periods(_stores(s, d), ev(s, d), tx(s, d), now="2024-02-01 00:00:00")


@query(f"select store_id, cast(date_trunc('hour', occurred_at) as timestamp) as bucket_start, cast(count(*) as double) as value from ev where event_type = 'vision.zone.entered' and {CUST} group by 1, 2 having count(*) <> 2")
def rollup_after_deletes(s, d):
    """Buckets of a versioned table after some are deleted. (K-08)"""
    m = metrics.footfall(ev(s, d)).select("store_id", "bucket_start", "value").withColumn("day", F.to_date("bucket_start"))
    table = versioned.VersionedTable(s, _folder(s, "deletes"), ["store_id", "bucket_start"], "day")
    table.upsert(m, "load", 0)
    table.delete(m.where("value = 2").select("store_id", "bucket_start", "day"), "gone", 0)
    return table.read().drop("day")


# ------------------------------------------------------------ events of frames and tracks
@query("""select idempotency_key, people, staff, occurred_at from (
  select 'frame-' || camera_id || '-' || frame_index || '-run1' as idempotency_key, count(*) as people, count(*) filter (is_staff) as staff, min(ts) as occurred_at, row_number() over (partition by store_id, camera_id order by frame_index) - 1 as n from fr group by store_id, camera_id, frame_index
) where n % 30 = 0""")
def frame_events(s, d):
    """(ST-14, ST-15)"""
    e = events.frame_events(adapter.frames(s, d), "run1", "tenant-1", "c")
    people = F.from_json("payload", "detections array<struct<class_external_id: string>>, tracks array<struct<state: string>>")
    return e.select("idempotency_key", people.alias("p"), C.from_iso("occurred_at").alias("occurred_at")).select(
        "idempotency_key", F.size("p.tracks").cast("long").alias("people"), F.size(F.filter("p.detections", lambda x: x["class_external_id"] == "staff")).cast("long").alias("staff"), "occurred_at")


@query("""with recursive """ + adapter.SQL + """, sg as (select *, sum(new_) over (partition by store_id, camera_id, local_track_id order by frame_index, event_id rows unbounded preceding) as run from (select *, case when frame_index - lag(frame_index) over (partition by store_id, camera_id, local_track_id order by frame_index, event_id) <= 24 then 0 else 1 end as new_ from fr))
select 'track-ended-' || store_id || ':' || local_track_id || '-' || camera_id || '-' || local_track_id || case when run > 1 then '-' || run else '' end as idempotency_key, min(ts) as first_seen, max(ts) as last_seen, case when bool_or(is_staff) then 'staff' else 'visitor' end as class_label
from sg group by store_id, camera_id, local_track_id, run""")
def track_ended_events(s, d):
    """Ends of segments of frames at most a day apart. (ST-10, ST-15)"""
    f = adapter.frames(s, d).withColumn("embedding", F.lit(None).cast("array<double>"))
    runs = tracking.segments(f, 24).withColumn("global_id", F.col("local_track_id").cast("string")).withColumn("is_staff", F.col("local_track_id") % 50 == 0)
    told = F.from_json("payload", "first_seen string, last_seen string, class_label string")
    e = events.track_ended_events(runs, "tenant-1", "c").select("idempotency_key", told.alias("p"))
    return e.select("idempotency_key", C.from_iso("p.first_seen").alias("first_seen"), C.from_iso("p.last_seen").alias("last_seen"), "p.class_label")
