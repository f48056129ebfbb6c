import collections
import json
import uuid
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aislelens import queries as retail
from aislelens.functions import columns as C
from aislelens.operators import identity, ingest, metrics, ordered, sales, visits, zones
from aislelens.sources import readers
from aislelens.streaming import jobs, tracking

T0 = datetime(2024, 1, 1, 10)
DATA = "/root/testdata/sf0.001"


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def signals(spark, rows):
    return spark.createDataFrame([("s", v, st, at(m)) for v, st, m in rows], "store_id string, visitor_key string, stage string, at timestamp_ntz")


def sessions(spark, tracks):
    return spark.createDataFrame([("s", t, False, at(0), at(50)) for t in tracks], "store_id string, external_track_id string, staff boolean, started_at timestamp_ntz, ended_at timestamp_ntz")


def test_funnel_golden(spark):
    sig = signals(spark, [("track:1", "ZONE_VISIT", 1), ("track:2", "ZONE_VISIT", 2), ("track:3", "ZONE_VISIT", 3), ("track:1", "BILLING_QUEUE", 4), ("track:2", "BILLING_QUEUE", 5), ("track:1", "PURCHASE", 6)])
    got = {r["stage"]: r for r in visits.funnel(visits.visitor_stages(sig, sessions(spark, "1234"))).collect()}
    assert [got[s]["visitors"] for s in C.STAGES] == [4, 3, 2, 1]
    assert [got[s]["conversion"] for s in C.STAGES] == [0.75, 0.6667, 0.5, None]
    assert got["ENTRY"]["drop_off"] == 0.25 and got["PURCHASE"]["drop_off"] is None


def test_funnel_reentry_and_skipped_stage(spark):
    sig = signals(spark, [("track:9", "ZONE_VISIT", m) for m in (1, 2, 3)])
    got = {r["stage"]: r for r in visits.funnel(visits.visitor_stages(sig, sessions(spark, ""))).collect()}
    assert got["ENTRY"]["visitors"] == 1 and got["ZONE_VISIT"]["reentries"] == 2


def test_heatmap(spark):
    rows = [("s", C.ENTERED, "a", "browse", None), ("s", C.ENTERED, "a", "browse", None), ("s", C.EXITED, "a", "browse", 30000.0), ("s", C.EXITED, "a", "browse", 50000.0), ("s", C.ENTERED, "b", "checkout", None), ("s", C.ENTERED, None, None, None)]
    e = spark.createDataFrame([(*r, "visitor") for r in rows], "store_id string, event_type string, zone_id string, zone_type string, dwell_ms double, class_label string").withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r["zone_key"]: r for r in zones.heatmap(e).collect()}
    assert got["id:a"]["avg_dwell"] == 40.0 and got["id:a"]["visit_norm"] == 1.0 and got["id:b"]["visit_norm"] == 0.0 and len(got) == 2


def test_rules(spark):
    counts = spark.createDataFrame([("s", "type:checkout", 30, 8, "checkout"), ("s", "type:browse", 40, 40, "browse"), ("s", "type:dead", 1, 0, "dead"), ("s", "id:checkout-1", 30, 8, "x"), ("s", "type:gone", 0, 9, "gone")], "store_id string, zone_key string, current long, baseline long, zone_label string")
    (spike,) = zones.queue_spikes(counts).collect()
    assert (spike["zone_key"], spike["severity"], spike["message"]) == ("type:checkout", "CRITICAL", "Queue spike in checkout: 30 visits vs baseline 8 (3.8x).")
    (dead,) = zones.dead_zones(counts).collect()
    assert dead["zone_key"] == "type:dead" and dead["message"] == "Dead zone detected: dead had only 1 visits (1.0% of store traffic, peak zone 40)."
    own = zones.thresholds({"anomalies": {"dead_zone_ratio": "0.8", "queue_zone_keys": ["ID:checkout-1"], "nonsense": 1}})
    assert own.dead_zone_ratio == 0.8 and [r["zone_key"] for r in zones.queue_spikes(counts, own).collect()] == ["id:checkout-1"]
    assert {r["zone_key"] for r in zones.dead_zones(counts, own).collect()} == {"type:dead", "type:checkout", "id:checkout-1"}
    feed = spark.createDataFrame([("a", 20.0), ("b", 61.0), ("c", 1.0), ("d", None)], "store_id string, age_minutes double")
    got = {r["store_id"]: (r["severity"], r["zone_key"], r["message"]) for r in zones.stale_feeds(feed).collect()}
    assert got == {"a": ("WARN", "feed", "Vision feed stale: last event 20 minutes ago."), "b": ("CRITICAL", "feed", "Vision feed stale: last event 61 minutes ago."), "d": ("CRITICAL", "none", "No vision feed events recorded for this store.")}
    now = spark.createDataFrame([("a", 20, 5, 0.25), ("b", 5, 1, 0.2)], "store_id string, entries long, purchases long, rate double")
    (drop,) = zones.conversion_drops(now, now.withColumn("rate", F.lit(0.75))).collect()
    assert drop["severity"] == "CRITICAL" and drop["message"] == "Conversion dropped 50% (baseline 75% → current 25%, 5/20 purchases)."
    ids = zones.anomaly_ids(zones.stale_feeds(feed), str(uuid.NAMESPACE_URL), "2024-02-01 10:59:00").where("store_id = 'a'").first()
    assert ids["anomaly_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "a:STALE_FEED:feed:2024-02-01T10:00:00+00:00"))
    stored = zones.anomaly_ids(zones.stale_feeds(feed), str(uuid.NAMESPACE_URL), "2024-02-01 10:00:00").withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    done = zones.resolve_anomalies(stored, stored.where("store_id = 'b'").select("anomaly_id"), "2024-02-02 00:00:00")
    assert {r["store_id"]: str(r["resolved_at"]) for r in done.collect()} == {"a": "None", "b": "2024-02-02 00:00:00", "d": "None"}
    assert [r["store_id"] for r in readers.list_anomalies(done, "a", "WARN", True).collect()] == ["a"] and readers.list_anomalies(done, "b", None, True).count() == 0


def test_linking(spark):
    bills = spark.createDataFrame([("s", "t1", at(0)), ("s", "t2", at(10)), ("s", "t3", at(500))], "store_id string, external_track_id string, billing_at timestamp_ntz")
    tx = spark.createDataFrame([(1, "s", "completed", at(1)), (2, "s", "completed", at(11)), (3, "s", "completed", at(900))], "transaction_id long, store_id string, status string, occurred_at timestamp_ntz")
    got = {r["external_track_id"]: (r["transaction_key"], r["method"]) for r in sales.link_orders(bills, tx, 1800).collect()}
    assert got == {"t1": ("1", "TIME_WINDOW"), "t2": ("2", "TIME_WINDOW"), "t3": ("3", "SEQUENTIAL")}


def test_ingest_matrix(spark):
    cols = "idx long, event_id string, event_type string, schema_version string, tenant_id string, store_id string, idempotency_key string, payload string"
    batch = spark.createDataFrame(
        [(0, "a", "vision.x", "1.0.0", None, "s1", "k", "{}"), (1, "a", "vision.x", "1", None, None, "k", '{"store_id": "s9"}'), (2, None, "other", "1.0", "t9", "s1", None, "{}")], cols
    )
    stores = spark.createDataFrame([("s1", "t1")], "known_store string, known_tenant string")
    v = ingest.validate(batch, stores)
    got = {r["idx"]: r["errors"] for r in v.collect()}
    assert got[0] == [] and got[1] == ["invalid_schema_version", "duplicate_event_id_in_batch", "duplicate_idempotency_key_in_batch"] and got[2] == ["invalid_event_type"]
    assert ingest.summary(v).first()["code"] == 207
    stored = spark.createDataFrame([("a", None)], "event_id string, idempotency_key string")
    assert {r["idx"]: r["outcome"] for r in readers.split_new_events(batch, stored).collect()} == {0: "duplicate_id", 1: "duplicate_id", 2: "created"}


def test_functions(spark):
    got = spark.range(1).select(
        C.uuid5(str(uuid.NAMESPACE_DNS), F.lit("store:1")).alias("u"), C.video_name(F.lit('"C:\\v\\cam 1.mp4"')).alias("v"), C.severity(F.lit("high")).alias("s"),
        C.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("c"),
    ).first()
    assert got["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "store:1")) and got["v"] == "cam 1.mp4" and got["s"] == "HIGH" and got["c"] == 0


FRAME = "store_id string, camera_id string, local_track_id int, frame_index long, ts timestamp, foot_x double, foot_y double, embedding array<double>, dark_ratio double"
BOX = [[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6]]


def frames(spark, rows):
    """(camera, track, second, x, y[, embedding, dark])"""
    full = [("s", c, t, int(k * 5), T0 + timedelta(seconds=k), x, y, *(more or ([1.0, 0.0], 0.0))) for c, t, k, x, y, *more in rows]
    return spark.createDataFrame(full, FRAME)


def moves(spark, rows, zones_, roles=None):
    return [(r["zone_id"], r["kind"], r["direction"], r["dwell_ms"]) for r in jobs.zone_moves(frames(spark, rows), {"C": zones_}, roles).orderBy("ts").collect()]


def zone(zid="z", kind="browse", **more):
    return {"zone_id": zid, "zone_type": kind, "points": BOX, **more}


def test_polygon_moves(spark):
    path = [("C", 1, k, 0.5 if 2 <= k <= 5 else 0.0, 0.5) for k in range(9)]
    assert moves(spark, path, [zone()]) == [("z", "enter", None, None), ("z", "exit", None, 4000)]
    quick = [("C", 1, 0, 0.5, 0.5), ("C", 1, 0.3, 0.9, 0.9), ("C", 1, 0.8, 0.9, 0.9)]
    assert moves(spark, quick, [zone()]) == [("z", "enter", None, None), ("z", "exit", None, 800)]  # out only after half a second
    edge = [("C", 1, 0, 0.5, 0.5), ("C", 1, 1, 0.5, 0.5999), ("C", 1, 2, 0.5, 0.7)]
    assert moves(spark, edge, [zone()])[-1] == ("z", "exit", None, 1000)  # in the slack at the edge counts as out
    again = [("C", 1, 0, 0.5, 0.5), ("C", 1, 1, 0.9, 0.9), ("C", 1, 2, 0.5, 0.5), ("C", 1, 9, 0.9, 0.9), ("C", 1, 14, 0.5, 0.5)]
    assert [m[1] for m in moves(spark, again, [zone()])] == ["enter", "exit", "exit", "enter"]  # one type again within 3 s is swallowed
    after = zone("q", "queue", dedupe_after_zone_types=["browse"])
    assert [m[0] for m in moves(spark, [("C", 1, 0, 0.5, 0.5)], [zone(), after])] == ["z"]
    assert moves(spark, [("C", 1, 0, 0.5, 0.5)], [zone(require_prior_zone_types=["aisle"])]) == []
    assert moves(spark, [("C", 1, 0, 0.5, 0.5)], [zone(), zone("m", "x", exclude_detections=True)]) == []


def test_line_crossing(spark):
    line = {"zone_id": "door", "zone_type": "entry_threshold", "kind": "line", "points": [[0.0, 0.5], [1.0, 0.5]], "direction_normal": [0, 1]}
    walk = lambda ys: [("C", 1, 3 * k, 0.5, y) for k, y in enumerate(ys)]
    assert moves(spark, walk([0.3, 0.45, 0.6, 0.7]), [line]) == [("door", "enter", "in", None)]
    assert moves(spark, walk([0.7, 0.3]), [line]) == [("door", "enter", "out", None)]
    assert moves(spark, walk([0.49, 0.504, 0.497]), [line]) == []  # within the slack
    assert moves(spark, walk([0.491, 0.5, 0.509]), [line]) == []  # hardly a way
    assert moves(spark, walk([0.3, 0.7]), [line | {"counting_only": True}]) == []
    fast = [("C", 1, 0, 0.5, 0.3), ("C", 1, 1, 0.5, 0.7), ("C", 1, 1.5, 0.5, 0.3), ("C", 1, 9, 0.5, 0.7)]
    assert [m[2] for m in moves(spark, fast, [line])] == ["in", "in"]  # back at once is debounced


def test_staff_signs():
    def track(steps, role="floor", zones_=(), dark=0.0):
        s = jobs.new_state()
        for ms, x, y in steps:
            jobs.track_step(s, list(zones_), role, ms, x, y, dark)
        return s["staff"]

    still = lambda n, ms=1000: [(k * ms, 0.5, 0.5) for k in range(n)]
    assert track(still(2), "backroom") == "backroom_camera" and track(still(46, 1000)) is None
    assert track(still(30), "billing", dark=0.9) == "dark_uniform" and track(still(30), dark=0.9) is None and track(still(60), dark=0.9) == "dark_uniform"
    assert track([(0, 0.5, 0.5), (200_000, 0.5, 0.5)], "billing") == "billing_long_presence" and track([(0, 0.5, 0.5), (900_000, 0.5, 0.5)]) == "long_presence"
    assert track([(0, 0.5, 0.5), (310_000, 0.5, 0.5)], zones_=[zone(kind="staff_only")]) == "zone_dwell" and track([(0, 0.5, 0.5), (100_000, 0.5, 0.5)], zones_=[zone(kind="checkout")]) is None
    assert track([(k * 100, 0.5 + 0.01 * (k % 2), 0.5) for k in range(40)]) == "repeated_movement" and track([(k * 100, 0.01 * k, 0.5) for k in range(40)]) is None
    other = {"zone_id": "a", "zone_type": "aisle", "points": [[0.7, 0.7], [0.9, 0.7], [0.9, 0.9], [0.7, 0.9]]}
    assert track([(k * 10_000, *((0.5, 0.5) if k % 2 else (0.8, 0.8))) for k in range(7)], zones_=[zone(kind="consultation"), other]) == "repeated_shuttle"


def identify(spark, rows, edges=None, roles=None):
    f = frames(spark, rows)
    runs = tracking.segments(f, 5)
    return {(r["camera_id"], r["local_track_id"], r["run"]): (r["global_id"], r["how"], round(r["score"], 4)) for r in tracking.resolve_identities(runs, edges or {}, roles).collect()}


def test_identities(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    edge = {("A", "B"): "P0"}
    got = identify(spark, [("A", 1, 0, 0.4, 0.4, a, 0.0), ("A", 1, 1, 0.4, 0.4, a, 0.0), ("B", 7, 30, 0.4, 0.4, a, 0.0)], edge)
    # Likeness 1, 30 s of 150 gone since the first sight, on an edge, dressed alike.
    assert got["B", 7, 1][0] == got["A", 1, 1][0] and got["B", 7, 1][1:] == ("matched", round(0.55 + 0.2 * (1 - 30 / 150) + 0.15 + 0.1, 4))
    got = identify(spark, [("A", 1, 0, 0.4, 0.4, a, 0.0), ("B", 7, 30, 0.4, 0.4, b, 0.0)], edge)
    assert got["B", 7, 1][:2] == (got["A", 1, 1][0], "solo")  # unlike, but the only visitor there
    got = identify(spark, [("A", 1, 0, 0.1, 0.4, a, 0.0), ("A", 2, 1, 0.9, 0.4, b, 0.0), ("B", 7, 30, 0.4, 0.4, [-1.0, -1.0], 0.0)], edge)
    assert got["B", 7, 1][1] == "new" and len({g[0] for g in got.values()}) == 3  # two at hand: no one is meant
    got = identify(spark, [("A", 1, 0, 0.4, 0.4, a, 0.0), ("A", 1, 1, 0.4, 0.4, a, 0.0), ("A", 9, 8, 0.45, 0.4, a, 0.0)])
    assert got["A", 9, 1][:2] == (got["A", 1, 1][0], "recovered")  # lost and found on its camera
    got = identify(spark, [("A", 1, 0, 0.4, 0.4, a, 0.0), ("A", 1, 1, 0.4, 0.4, a, 0.0), ("A", 1, 3000, 0.4, 0.4, a, 0.0)])
    assert got["A", 1, 2][1] == "new"  # forgotten after 45 minutes
    got = identify(spark, [("A", 1, 0, 0.4, 0.4, a, 0.0), ("B", 7, 200, 0.4, 0.4, a, 0.0)], edge)
    assert got["B", 7, 1][1] == "new"  # too late for the edge


def test_store_of_frames(spark):
    line = {"zone_id": "door", "zone_type": "entry_threshold", "kind": "line", "points": [[0.0, 0.5], [1.0, 0.5]], "direction_normal": [0, 1]}
    shelf, queue = zone("shelf", "aisle"), zone("till", "billing_queue")
    walk = lambda cam, t, at, ys, x=0.2: [(cam, t, at + k, x, y) for k, y in enumerate(ys)]
    rows = walk("A", 1, 0, [0.3, 0.45, 0.6, 0.7]) + walk("B", 4, 20, [0.5] * 3, 0.5) + walk("C", 5, 40, [0.5] * 3, 0.5) + walk("A", 6, 100, [0.7, 0.55, 0.4, 0.3]) + walk("A", 7, 300, [0.3, 0.45, 0.6, 0.7])
    rules = [{"suppress_camera": "C", "suppress_zone_types": ["aisle"], "active_camera": "B", "active_zone_types": ["billing_queue"], "within_seconds": 180}]
    f = frames(spark, rows)
    who = tracking.track_store(f, {"A": [line], "B": [queue], "C": [shelf]}, {("A", "B"): "P0", ("B", "C"): "P0", ("C", "A"): "P0"}, {"A": "entry", "B": "billing"}, rules, 5, 60)
    got = [(r["camera_id"], r["zone_type"], r["direction"], r["suppressed"], r["session_no"], r["is_reentry"], r["is_store_exit"]) for r in who.orderBy("ts").collect()]
    assert got == [
        ("A", "entry_threshold", "in", False, 1, False, False), ("B", "billing_queue", None, False, 1, False, False), ("C", "aisle", None, True, 1, False, False),
        ("A", "entry_threshold", "out", False, 1, False, True), ("A", "entry_threshold", "in", False, 2, True, False),
    ]
    assert len({r["global_id"] for r in who.collect()}) == 1
    ses = {r["session_no"]: (r["is_reentry"], str(r["ended_at"])) for r in tracking.session_rows(who).collect()}
    assert ses[1][0] is False and ses[1][1] != "None" and ses[2] == (True, "None")
    doors = tracking.store_sessions(f, {"A": [line], "B": [queue], "C": [shelf]}, {("A", "B"): "P0", ("B", "C"): "P0", ("C", "A"): "P0"}, {"A": "entry", "B": "billing"}, rules, 5, 60)
    assert {r["session_no"]: (r["is_reentry"], str(r["ended_at"])) for r in doors.collect()} == ses
    e = {(r["idempotency_key"].split("-")[0], json.loads(r["payload"])["camera_id"]): (r, json.loads(r["payload"])) for r in tracking.envelopes(who.where("session_no = 1 and camera_id <> 'A' or is_store_exit or not is_reentry and direction = 'in'"), "t", "c").collect()}
    row, body = next(v for v in e.values() if v[1]["camera_id"] == "B")
    assert row["event_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, row["idempotency_key"])) and body["external_track_id"].startswith("s:") and row["occurred_at"].endswith("Z") and not any(k[1] == "C" for k in e)


def test_zone_moves_stream_equals_batch(spark, tmp_path):
    rows = [("C", t, k, 0.5 if (k + t) % 7 < 3 else 0.1, 0.5) for t in (1, 2, 3) for k in range(30)]
    f, src = frames(spark, rows), str(tmp_path / "in")
    for k in range(3):  # three micro-batches
        f.where(f"frame_index >= {k * 50} and frame_index < {k * 50 + 50}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(src)
    zs = {"C": [zone()]}
    q = jobs.zone_moves(stream, zs).writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    key = lambda df: sorted((r["local_track_id"], str(r["ts"]), r["kind"], r["dwell_ms"]) for r in df.collect())
    assert key(spark.table("moves")) == key(jobs.zone_moves(f, zs)) and len(key(spark.table("moves"))) > 10


def test_stream_jobs(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("k1", "s", C.ENTERED, "visitor", "browse", at(0)), ("k1", "s", C.ENTERED, "visitor", "browse", at(0)), ("k2", "s", C.ENTERED, "visitor", "browse", at(5)), ("k3", "s", C.ENTERED, "staff", "browse", at(6)), ("k4", "s", C.ENTERED, "visitor", "browse", at(70))]
    spark.createDataFrame(rows, "idempotency_key string, store_id string, event_type string, class_label string, zone_type string, occurred_at timestamp").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("idempotency_key string, store_id string, event_type string, class_label string, zone_type string, occurred_at timestamp").parquet(src)
    run = lambda w, name: w.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(180)
    run(jobs.deduplicated(stream()).writeStream.format("memory").queryName("once").outputMode("append"), "a")
    assert spark.table("once").count() == 4
    run(jobs.hourly_footfall(stream()).writeStream.format("memory").queryName("hours").outputMode("complete"), "b")
    assert sorted((str(r["bucket_start"]), r["value"]) for r in spark.table("hours").collect()) == [("2024-01-01 10:00:00", 3), ("2024-01-01 11:00:00", 1)]
    seen = []
    run(stream().writeStream.foreachBatch(jobs.upsert_each_batch(lambda df, epoch: seen.append((epoch, df.count(), "load_no" in df.columns)))), "c")
    assert seen == [(0, 5, True)]
    assert jobs.snapshot_every(stream(), lambda df, n: None) is not None
    f = spark.createDataFrame([("s", "A", k, at(k)) for k in range(10)], "store_id string, camera_id string, frame_index long, ts timestamp")
    assert jobs.sampled(f, 25, 5).count() == 2 and [r["frame_index"] for r in jobs.emitted_frames(f, 4).orderBy("frame_index").collect()] == [0, 4, 8]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("s", "1", at(m)) for m in (0, 5, 50, 51, 200)], "store_id string, external_track_id string, occurred_at timestamp").write.parquet(src)
    stream = spark.readStream.schema("store_id string, external_track_id string, occurred_at timestamp").parquet(src)
    q = jobs.live_sessions(stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["session_no"], r["n_events"]) for r in spark.table("live").orderBy("session_no").collect()][:2] == [(1, 2), (2, 2)]


@pytest.mark.parametrize("name", ["footfall_hourly", "event_kpis", "coverage", "sessions", "funnel", "journeys", "heatmap", "layout_heatmap", "anomalies", "link_orders", "validate_events", "handoffs", "id_switches", "reviewer_proof"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = retail.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(retail.oracle_sql()[name])
    names = [x[0] for x in r.description]
    key = lambda row: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)
    want = sorted(key([row[names.index(c)] for c in cols]) for row in r.fetchall())
    assert sorted(key(r) for r in df.select(*cols).collect()) == want


def test_conversion_drops_of_windows(spark, monkeypatch):
    kind = "event_id long, store_id string, event_type string, occurred_at timestamp_ntz, external_track_id string, class_label string, zone_type string, is_store_entry boolean"
    rows, sold = [], []
    for store, share in (("s1", 2), ("s2", 1), ("s3", 5)):
        for day, buyers in ((8, 10 * 4 // 5), (18, 10 // share)):
            for k in range(10):
                when = datetime(2024, 1, day, 10, k)
                rows.append((2 * len(rows) + 1, store, C.ENTERED, when, f"{store}-{day}-{k}", "visitor", "entry_threshold", True))
                if k < buyers:
                    sold.append((len(sold), store, "completed", when + timedelta(minutes=5), f"{store}-{day}-{k}"))
    rows.append((1, "s1", C.ENTERED, datetime(2024, 1, 2), "early", "visitor", "entry_threshold", True))
    sold.append((len(sold), "s1", "completed", datetime(2024, 2, 1), "s1-18-9"))
    e, t = spark.createDataFrame(rows, kind), spark.createDataFrame(sold, "transaction_id long, store_id string, status string, occurred_at timestamp_ntz, external_track_id string")
    monkeypatch.setattr(retail, "ev", lambda s, d: e)
    monkeypatch.setattr(retail, "tx", lambda s, d: t)
    got = {(r["store_id"], r["severity"], r["measure"]) for r in retail.queries()["conversion_drops"](spark, "").collect()}
    assert got == {("s1", "CRITICAL", 0.3), ("s3", "CRITICAL", 0.6)}


def test_purchases_linked_by_session(spark):
    ses = spark.createDataFrame([("s", "a", "1", False, at(0)), ("s", "b", None, False, at(0)), ("s", "c", "3", True, at(0))], "store_id string, session_id string, external_track_id string, staff boolean, started_at timestamp_ntz")
    e = spark.createDataFrame(
        [("s", C.ENTERED, at(1), k, t, "visitor", "billing_queue") for k, t in (("a", None), ("b", None), ("c", "3"), (None, "9"), ("gone", "7"), (None, None))]
        + [("s", C.PURCHASE, at(2), k, None, None, None) for k in ("a", "b", "c")],
        "store_id string, event_type string, occurred_at timestamp_ntz, session_id string, external_track_id string, class_label string, zone_type string",
    )
    t = spark.createDataFrame([(k, "s", "completed", at(10 + k), x, y, 5.0) for k, (x, y) in enumerate([("a", None), ("b", None), ("c", "3"), (None, "9"), ("gone", None), (None, None)])], "transaction_id long, store_id string, status string, occurred_at timestamp_ntz, session_id string, external_track_id string, amount double")
    sig = visits.signals(e, t, ses)
    got = collections.Counter((r["visitor_key"], r["stage"]) for r in sig.collect())
    assert got == {("track:1", "BILLING_QUEUE"): 1, ("session:b", "BILLING_QUEUE"): 1, ("track:9", "BILLING_QUEUE"): 1, ("track:1", "PURCHASE"): 2, ("session:b", "PURCHASE"): 1, ("track:9", "PURCHASE"): 1}
    assert {(r["session_id"]) for r in visits.missing_sessions(e, t, ses.where("session_id = 'a'")).collect()} == {"b", "c", "gone"}
    assert visits.sessions_by_id(ses, spark.createDataFrame([("s", "b")], "store_id string, session_id string")).count() == 1
    assert {r["external_track_id"]: r["session_id"] for r in sales.latest_session_by_track(ses).collect()} == {"1": "a", "3": "c"}
    assert readers.active_session(ses.withColumn("status", F.lit("active")), "s", "1").count() == 1 and readers.by_id(ses, "session_id", "c").count() == 1
    filled = visits.backfill_sessions(spark.createDataFrame([("s", "1", None), ("s", "3", "x"), ("s", "5", None)], "store_id string, external_track_id string, session_id string"), ses)
    assert {r["external_track_id"]: r["session_id"] for r in filled.collect()} == {"1": "a", "3": "x", "5": None}


def test_sessions_by_store_and_track(spark):
    rows = [("s1", "1", C.ENTERED, 0, "visitor", "browse"), ("s1", "1", C.EXITED, 90, "visitor", "browse"), ("s2", "1", C.ENTERED, 5, "visitor", "entrance"), ("s1", "2", C.ENTERED, 1, "staff", "browse"), ("s1", "3", C.ENTERED, 1, "visitor", "staff_only"),
            ("s1", "4", C.EXITED, 2, None, None), ("s1", "4", C.ENDED, 3, None, None), ("s1", "", C.ENTERED, 3, None, None), ("s1", "5", C.PURCHASE, 3, None, None)]
    e = spark.createDataFrame([(s_, t, k, at(m), c_, z) for s_, t, k, m, c_, z in rows], "store_id string, external_track_id string, event_type string, occurred_at timestamp_ntz, class_label string, zone_type string")
    got = {(r["store_id"], r["external_track_id"]): (r["started_at"], r["ended_at"], r["status"], r["store_entry"]) for r in visits.materialize_sessions(e).collect()}
    assert got == {("s1", "1"): (at(0), at(90), "active", True), ("s2", "1"): (at(5), at(5), "active", True), ("s1", "4"): (at(2), at(3), "completed", False)}
    assert visits.materialize_sessions(e, True).where("staff").count() == 2


def test_kpi_cascades(spark):
    kind = "store_id string, external_track_id string, event_type string, occurred_at timestamp_ntz, class_label string, zone_type string, zone_id string, is_store_entry boolean, is_store_exit boolean"
    row = lambda st, t, k, c_="visitor", z="browse", i=False, o=False: (st, t, k, at(0), c_, z, None, i, o)
    e = spark.createDataFrame([
        row("flag", "1", C.ENTERED, "staff", i=True), row("flag", "2", C.ENTERED, z="entry"), row("flag", "2", C.ENTERED, o=True), row("flag", "9", C.FRAME, "staff"),
        row("door", "1", C.ENTERED, z="entry"), row("door", "1", C.ENTERED, z="entrance"), row("door", "2", C.ENTERED, "staff", "entry"), row("door", "3", C.ENDED),
        row("any", "1", C.ENTERED), row("any", "2", C.EXITED), row("any", None, C.ENTERED),
    ], kind)
    got = {r["store_id"]: (r["visitors"], r["store_entries"], r["store_exits"], r["staff_filtered"]) for r in metrics.event_kpis(e).collect()}
    assert got == {"flag": (1, 1, 1, 2), "door": (1, 1, 1, 1), "any": (2, 1, 0, 0)}


def test_stages(spark):
    rows = [("entry", None, C.ENTERED), ("AISLE", None, C.ENTERED), ("browse_x", None, C.ENTERED), ("vip", None, C.ENTERED), ("aisle", "purchase", C.ENTERED), ("aisle", "wrong", C.ENTERED), (None, None, C.PURCHASE), ("queue", None, C.PURCHASE)]
    df = spark.createDataFrame(rows, "zone_type string, named string, event_type string")
    got = [r[0] for r in df.select(C.stage(F.col("named"), {"VIP": "zone_visit", "x": "nothing"})).collect()]
    assert got == ["ENTRY", "ZONE_VISIT", None, "ZONE_VISIT", "PURCHASE", None, "PURCHASE", "BILLING_QUEUE"]
    assert [r[0] for r in spark.createDataFrame([("ENTRY",), ("odd",)], "s string").select(C.stage_label("s")).collect()] == ["Visitor", "odd"]


def test_journeys_of_tracks(spark):
    sig = signals(spark, [("track:1", "BILLING_QUEUE", 5), ("track:2", "ZONE_VISIT", 1), ("session:x", "ENTRY", 0), ("track:4", "PURCHASE", 9)])
    e = spark.createDataFrame([("s", "1", C.ENTERED, "checkout"), ("s", "1", C.ENTERED, "aisle"), ("s", "2", C.EXITED, "aisle")], "store_id string, external_track_id string, event_type string, zone_type string")
    t = spark.createDataFrame([(1, "s", "1", 5.0, "completed", at(8), "sequential"), (2, "s", "1", 7.0, "completed", at(7), None), (4, "s", "4", 99.0, "completed", at(9), None), (5, "s", None, 1.0, "completed", at(9), None)], "transaction_id long, store_id string, external_track_id string, amount double, status string, occurred_at timestamp_ntz, link_method string")
    j = visits.journeys(sig, e, t)
    got = {r["visitor_key"]: (r["entry_at"], r["zone_at"], r["purchase_at"], r["zones"], r["transaction_id"], r["complete"], r["stage_count"]) for r in j.collect()}
    assert got["track:1"] == (at(5), at(5), at(8), "aisle,checkout", 1, True, 4) and got["track:2"] == (None, at(1), None, "", None, False, 1)
    assert got["session:x"][0] == at(0) and got["track:4"] == (at(9), None, at(9), "", 4, False, 2)
    assert [r["visitor_key"] for r in j.orderBy(*visits.journey_order()).collect()][:2] == ["track:1", "track:4"]
    assert visits.journey_summary(j, t).first().asDict() == {"store_id": "s", "journeys": 4, "complete": 1, "with_billing": 1, "billing_to_purchase": 1.0, "linked_purchases": 1, "orphan_purchases": 1}


def test_till_export(spark, tmp_path):
    head = "order_id,invoice_number,invoice_type,order_date,order_time,store_id,brand_name,dep_name,sub_category,qty,GMV,NMV,total_amount,customer_name,offer_name"
    lines = ["1,i1,SALES,10-04-2026,12:01:02,ST1,Acme,Skin,Cream,2.0,10.50,9.50,9.50, Ann ,", "1,i1,Sales,10-04-2026,12:01:02,ST1,,,,x,1,,1,Ann,", "2,i2,return,10-04-2026,12:01:02,ST1,Acme,Skin,Cream,1,1,1,1,,", "3,i3,sales,bad,12:01:02,ST2,Acme,Skin,Cream,1,1,1,1,,", "4,i4,sales,10-04-2026,09:00:00,ST1,Zed,Skin,Cream,1,3,3,3,,"]
    (tmp_path / "pos.csv").write_text("\n".join([head, *lines]))
    raw = readers.read_pos_csv(spark, str(tmp_path / "pos.csv"))
    assert set(readers.POS_COLUMNS) <= set(raw.columns) and all(raw.schema[c].dataType.simpleString() == "string" for c in readers.POS_COLUMNS)
    got = sales.parse_pos(raw, "ST1")
    assert [(r["brand_name"], r["category"], r["qty"], float(r["nmv"])) for r in got.orderBy("line_no").collect()] == [("Acme", "Skin/Cream", 2, 9.5), ("Unknown", "unknown/unknown", 0, 0.0), ("Zed", "Skin/Cream", 1, 3.0)]
    o = sales.orders(got, ("brand_name", "invoice_number", "occurred_at")).orderBy(*sales.order_sequence()).collect()
    assert [(r["order_id"], r["nmv"], r["total_amount"], r["line_count"], r["first_brand_name"]) for r in o] == [("4", 3.0, 3.0, 1, "Zed"), ("1", 9.5, 10.5, 2, "Acme")]
    p = sales.column_profile(raw).first()
    assert (p["line_count"], p["order_count"], p["time_columns"]) == (5, 4, 2)


def test_events_in_and_out(spark, tmp_path):
    one = {"event_id": "a", "event_type": "vision.x", "store_id": "s", "occurred_at": "2024-01-01T10:00:00Z", "payload": {"session_id": "q", "k": True}, "odd": 1}
    (tmp_path / "e.jsonl").write_text(json.dumps(one) + "\n\n" + json.dumps(one | {"event_id": "b"}) + "\n")
    got = readers.read_events_jsonl(spark, str(tmp_path / "e.jsonl"))
    assert sorted(r["event_id"] for r in got.collect()) == ["a", "b"] and json.loads(got.first()["payload"])["k"] is True
    stream = readers.stream_events_jsonl(spark, str(tmp_path) + "/*.jsonl")
    stream.writeStream.format("memory").queryName("jsonl").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("jsonl").count() >= 2
    raw = spark.createDataFrame([(json.dumps(one),), (json.dumps({"events": [one, one | {"event_id": "c" * 200}]}),)], "value string")
    b = readers.unwrap_batches(raw)
    assert sorted((r["idx"], r["request_size"]) for r in b.collect()) == [(0, 1), (0, 2), (1, 2)]
    v = ingest.validate(b.withColumn("idx", F.monotonically_increasing_id()).withColumn("default_correlation", F.lit("dc")), spark.createDataFrame([("s", "t", None), ("z", "t", "x")], "known_store string, known_tenant string, deleted_at string"))
    rows = v.collect()
    assert all("extra_fields" in r["errors"] and r["session_id"] == "q" and r["correlation_id"] == "dc" and r["tenant_id"] == "t" for r in rows)
    assert ingest.messages(v).where("message like '%extra_fields%'").count() == 3 and ingest.summary(v).first()["code"] == 422
    big = ingest.validate(b.withColumn("request_size", F.lit(501)).withColumn("store_id", F.lit("no")), spark.createDataFrame([("s", "t")], "known_store string, known_tenant string"), uuids=True)
    assert all({"invalid_batch_size", "invalid_store_id"} <= set(r["errors"]) for r in big.collect())
    e = retail.ev(spark, DATA)
    out = readers.exported(e, "store-1", drop_mock=True)
    readers.write_jsonl(out, str(tmp_path / "out"))
    back = readers.read_events_jsonl(spark, str(tmp_path / "out"))
    assert back.count() == e.where("store_id = 'store-1' and event_type like 'vision.%' and detector_mode <> 'mock'").count() > 0
    assert back.where(C.from_iso("occurred_at").isNull()).count() == 0 and back.select(C.iso_utc(C.from_iso("occurred_at")) == F.col("occurred_at")).distinct().collect() == [(True,)]
    readers.append(out.limit(3), str(tmp_path / "kept"))
    readers.append(out.limit(2), str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 5
    two = spark.createDataFrame([("x", 1), ("y", 2)], "store_id string, v int")
    readers.replace_partition(two, str(tmp_path / "parts"), "store_id")
    readers.replace_partition(two.where("v = 2").withColumn("v", F.lit(9)), str(tmp_path / "parts"), "store_id")
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "parts")).collect()) == [1, 9]
    n = readers.batch_numbers(spark.range(1050).withColumnRenamed("id", "v"), "v", 100).groupBy("batch_id").count().collect()
    assert max(r["count"] for r in n) <= 100 and sum(r["count"] for r in n) == 1050
    tx = spark.createDataFrame([("s", "r1", 0), ("s", "r1", 1), ("s", "r2", 2), ("s", None, 3), ("s", None, 4)], "store_id string, external_ref string, load_no long")
    new = readers.new_transactions(tx, tx.where("external_ref = 'r2'"))
    assert sorted(r["load_no"] for r in new.collect()) == [0, 3, 4]


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"b": 1, "c": [1]}, "d": 2}))
    got = readers.pipeline_config(str(tmp_path / "c.json"), {"a": {"b": 0, "x": 5}}, {"PIPELINE_A__B": "7", "OTHER": "1", "PIPELINE_E": "z"})
    assert got == {"a": {"b": "7", "x": 5, "c": [1]}, "d": 2, "e": "z"}
    files = spark.createDataFrame([("/v/x/CAM 1.mp4",), ("/v/cam_1.mp4",), ("/v/Cam-2.MP4",), ("/v/other.mp4",)], "path string")
    cams = spark.createDataFrame([("c1", "CAM 1", "cam1.mp4"), ("c2", "Door", "CAM2.mp4")], "camera_id string, name string, video string")
    assert {r["path"]: (r["camera_id"], r["target"]) for r in readers.match_videos(files, cams).collect()} == {"/v/cam_1.mp4": ("c1", True), "/v/x/CAM 1.mp4": ("c1", False), "/v/Cam-2.MP4": ("c2", True), "/v/other.mp4": (None, False)}
    f = readers.layout_frames(spark, retail.LAYOUT)
    assert {r["layout_id"]: r["section_label"] for r in f["zones"].collect()} == {"wall": "Front of house", "till": "back"} and f["brand_bays"].count() == 2


def test_scalar_functions(spark):
    one = spark.createDataFrame([('{"n": "12", "l": [1, 2], "z": null, "f": "True"}', 3.0, 4.0, [1.0, 0.0], [0.0, 1.0], "2024-01-31T10:00:00.250000Z", "CAM1", 0.1234, 1234.5)], "p string, x double, y double, a array<double>, b array<double>, t string, cam string, share double, money double")
    box = F.struct(F.lit(0.2).alias("x"), F.lit(0.2).alias("y"), F.lit(0.2).alias("w"), F.lit(0.4).alias("h"))
    g = one.withColumn("bbox", box).withColumn("confidence", F.lit(0.9)).withColumn("poly", F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in BOX))).select(
        C.json_int("p", "n").alias("n"), C.json_int("p", "f").alias("bad"), C.json_items("p", "l").alias("items"), C.json_items("p", "n").alias("none"), C.has_key("p", "z").alias("z"), C.has_key("p", "q").alias("q"), C.json_flag("p", "f").alias("flag"),
        C.line_side("x", "y", (0, 0), (1, 0), (0.26, 0.15)).alias("given"), C.line_side("x", "y", (0, 0), (2, 0)).alias("own"), C.side_sign(F.lit(0.001), 0.01).alias("zero"), C.side_sign(F.lit(-0.1), 0.01).alias("minus"),
        C.blended("a", "b", 0.35).alias("mix"), C.iso_utc(C.from_iso("t")).alias("iso"), C.percent("share").alias("pc"), C.money_text("money", "₹").alias("m"), C.detection_ok(0.1, 0.01, 0.5, 0.5).alias("ok"),
        C.foot_point("bbox").alias("foot"), C.scaled_polygon("poly", 0.5)[0].alias("corner"), C.top_left("x", "y", "x", "y", 10, 10).alias("tl"), C.clock(F.lit("2024-01-01 00:00:00")).alias("clock"),
        C.match_score(F.lit(1.0), F.lit(30.0), F.lit(150.0), F.lit(1.0), F.lit(1.0)).alias("score"), C.max_handoff(F.lit("P0"), F.lit("floor"), F.lit("billing")).alias("h0"), C.max_handoff(F.lit(None).cast("string"), F.lit("x"), F.lit("y")).alias("h2"), C.handoff_reason(F.lit(0.5)).alias("why"),
        C.emitted(F.lit("aisle"), F.lit(True)).alias("e1"), C.emitted(F.lit("staff_only"), F.lit(True)).alias("e2"), C.emitted(F.lit("ignore"), F.lit(False)).alias("e3"), C.store_entry(F.lit("in"), F.lit("entrance")).alias("se"), C.severity(F.lit("warning")).alias("w"), C.severity(F.lit("odd")).alias("o"),
    ).first()
    assert (g["n"], g["bad"], g["items"], g["none"], g["z"], g["q"], g["flag"]) == (12, None, 2, 0, True, False, True)
    assert abs(g["given"] - (3 * 0.26 + 4 * 0.15)) < 1e-9 and g["own"] == 4.0 and (g["zero"], g["minus"]) == (0, -1)
    assert abs(sum(x * x for x in g["mix"]) - 1) < 1e-9 and g["iso"] == "2024-01-31T10:00:00.250000Z" and g["pc"] == "12.3%" and g["m"] == "₹1,234.50" and g["ok"]
    assert (round(g["foot"]["x"], 6), round(g["foot"]["y"], 6)) == (0.3, 0.6) and round(g["corner"]["x"], 6) == 0.45 and g["tl"]["x"] == 0.15 and str(g["clock"]) == "2024-01-01 00:00:00"
    assert round(g["score"], 4) == 0.96 and (g["h0"], g["h2"]) == (210.0, 270.0) and g["why"].asDict() == {"method": "p0_solo_handoff", "match_score": 0.85}
    assert (g["e1"], g["e2"], g["e3"], g["se"], g["w"], g["o"]) == (False, True, False, True, "WARN", "ODD")


def test_audit_figures(spark):
    assert metrics.dataset_score(5, 5, {"events": 9, "entries": 1, "exits": 1, "visitors": 1, "queue_events": 1, "summary": 1, "stages": 1, "transactions": 1, "purchases": 1, "frames": 100}) == 100
    assert metrics.dataset_score(0, 0, {}) == 30
    cases = spark.createDataFrame([(True, False, True), (True, True, True), (False, False, False), (True, False, False)], "expected_staff boolean, legacy_staff boolean, improved_staff boolean")
    assert metrics.contamination(cases).first() == (1, 2, 2, 1)
    k = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "kpi string, value double")
    assert {r["kpi"]: r["match"] for r in metrics.kpi_audit(k, k.where("kpi = 'a'")).collect()} == {"a": True, "b": False}
    checks = spark.createDataFrame([(str(n), n < 6) for n in range(8)], "name string, passed boolean")
    assert metrics.readiness(checks).first() == (6, 8, True)
    e = retail.ev(spark, DATA)
    assert metrics.has_data(e, "store-1") and not metrics.has_data(e, "store-9")
    assert metrics.latest_feed(e, "2024-01-10 00:00:00").where("last_event > timestamp_ntz'2024-01-10 00:00:00'").count() == 0
    assert spark.range(1).select(identity.shared_zone_types(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))).first()[0]
    buys = spark.createDataFrame([("s", "o1", None, None), ("s", "o2", "x", "q"), ("s", "o3", None, None)], "store_id string, order_id string, external_track_id string, session_id string")
    links = spark.createDataFrame([("s", "o1", "t1", "s1", at(1)), ("s", "o2", None, None, at(1))], "store_id string, order_id string, external_track_id string, session_id string, occurred_at timestamp_ntz")
    assert {r["order_id"]: (r["external_track_id"], r["session_id"]) for r in sales.backfill_tracks(buys, links).collect()} == {"o1": ("t1", "s1"), "o2": ("x", "q"), "o3": (None, None)}


def test_ordered_work_in_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{k % 2}", float(t), k, int(rng.integers(3))) for k, t in enumerate(np.cumsum(rng.exponential(10, 400)))]
    df = spark.createDataFrame(rows, "store_id string, at double, id long, v int").repartition(7)
    want_rank, want_chain, want_changes = {}, {}, collections.Counter()
    for st in ("s0", "s1"):
        mine, chain = sorted((r[1], r[2], r[3]) for r in rows if r[0] == st), 0
        for i, (t, k, v) in enumerate(mine):
            chain += i > 0 and t - mine[i - 1][0] > 30
            want_rank[k], want_chain[k] = i + 1, chain
            want_changes[st] += i > 0 and v != mine[i - 1][2]
    assert {r["id"]: r["rn"] for r in ordered.ranked(df, ["store_id"], ["at", "id"]).collect()} == want_rank
    assert {r["id"]: r["chain"] for r in ordered.chains(df, ["store_id"], "at", ["id"], 30).collect()} == want_chain
    assert {r["store_id"]: r["changes"] for r in ordered.changes(df, ["store_id"], ["at", "id"], "v").collect()} == dict(want_changes)
