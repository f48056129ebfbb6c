"""Sessions by door events, in batch and as a stream."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislelens.streaming import sessions

T0 = datetime(2024, 1, 1, 10)
MOVE = "store_id string, global_id string, ts timestamp, camera_id string, zone_type string, kind string, direction string, is_staff boolean"
RULES = dict(suppress=[{"suppress_camera": "AISLE", "suppress_zone_types": ["entrance"], "active_camera": "DOOR", "active_zone_types": ["entrance"], "within_seconds": 5}], roles={"DOOR": "entry", "AISLE": "entry"})


def move(s, zone_type="entry_threshold", direction=None, kind="enter", who="p", camera="DOOR", staff=False, store="s"):
    return (store, who, T0 + timedelta(seconds=s), camera, zone_type, kind, direction, staff)


def rows(df):
    sec = lambda t: None if t is None else (t - T0).total_seconds()
    return sorted(((r["store_id"], r["global_id"], r["session_no"], sec(r["started_at"]), sec(r["last_at"]), sec(r["ended_at"]), r["is_reentry"], r["staff"]) for r in df.collect()), key=str)


def batch(spark, events, **more):
    return [r[2:] for r in rows(sessions.sessions_by_doors(spark.createDataFrame(events, MOVE), sessions.Rules(**RULES, **more)))]


def test_in_out_resume_and_again(spark):
    day = [move(0, direction="in"), move(60, "browse"), move(600, direction="out"), move(600 + 1800, direction="in"), move(2500, direction="out")]
    assert batch(spark, day) == [(1, 0, 2500, 2500, False, False)]  # within half an hour the session goes on
    day = [move(0, direction="in"), move(600, direction="out"), move(600 + 1801, direction="in"), move(2500, "browse")]
    assert batch(spark, day) == [(1, 0, 600, 600, False, False), (2, 2401, 2500, None, True, False)]
    assert batch(spark, [move(0, "entrance", "in"), move(5, "entrance")]) == [(1, 0, 5, None, False, False)]
    assert batch(spark, [move(0, "entrance", camera="FLOOR"), move(5, direction="out"), move(9, "browse")]) == []
    assert batch(spark, [move(0, direction="in"), move(2701, direction="in"), move(2800, direction="out")]) == [(1, 0, 0, None, False, False), (1, 2701, 2800, 2800, False, False)]  # forgotten between


def test_staff_ends_and_marks_the_session(spark):
    day = [move(0, direction="in"), move(300, "browse"), move(1200, "browse", staff=True), move(1300, "billing_queue", staff=True), move(1400, "staff_only", staff=True)]
    assert batch(spark, day) == [(1, 0, 1200, 1200, False, True)]
    assert batch(spark, [move(0, direction="in"), move(20, None, kind="staff", staff=True), move(30, direction="in", staff=True)]) == [(1, 0, 20, 20, False, True)]
    assert batch(spark, [move(0, direction="in"), move(10, "staff_only", staff=True)]) == [(1, 0, 10, None, False, False)]


def test_found_again_soon_takes_the_session_up(spark):
    found = lambda s: move(s, None, kind="recovered")
    assert batch(spark, [move(0, direction="in"), move(100, direction="out"), found(145), move(200, "browse")]) == [(1, 0, 200, None, False, False)]
    assert batch(spark, [move(0, direction="in"), move(100, direction="out"), found(146), move(200, "browse")]) == [(1, 0, 100, 100, False, False)]
    assert batch(spark, [found(0), move(5, "browse")]) == []
    assert batch(spark, [move(0, direction="in"), found(400), move(500, direction="out")]) == [(1, 0, 500, 500, False, False)]


def test_another_camera_tells_it_already(spark):
    day = [move(0, "entrance"), move(3, direction="out"), move(4, "entrance", camera="AISLE"), move(9, "entrance", camera="AISLE")]
    assert batch(spark, day)[0][:4] == (1, 0, 9, None)  # hidden at 4, resumed at 9
    assert batch(spark, day[:3]) == [(1, 0, 3, 3, False, False)]
    assert batch(spark, [*day[:2], move(3.5, "entrance", kind="exit"), day[2]])[0][:4] == (1, 0, 4, None)  # left: not active any more


@pytest.mark.parametrize("seed", range(2))
def test_stream_equals_batch_and_forgets(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    events = []
    for store in "ab":
        for who in range(12):
            t = 0.0
            for _ in range(25):
                t += float(rng.choice([2, 20, 40, 400, 1900, 2600, 2900], p=[0.3, 0.2, 0.15, 0.15, 0.1, 0.05, 0.05])) + float(rng.random())
                zone, way = [("entry_threshold", "in"), ("entry_threshold", "out"), ("entrance", None), ("browse", None)][rng.integers(4)]
                kind = str(rng.choice(["enter", "enter", "enter", "exit", "recovered"]))
                events.append(move(round(t, 3), zone, way if kind == "enter" else None, kind, f"p{who}", str(rng.choice(["DOOR", "AISLE"])), bool(rng.random() < 0.06), store))
    events.sort(key=lambda e: e[2] + timedelta(seconds=float(rng.uniform(0, 500))))  # out of order by less than the delay
    last = move(400_000, "browse", None, "enter", "sentinel", "FLOOR", False, "z")
    src = str(tmp_path / "in")
    schema = spark.createDataFrame([], MOVE).schema
    for k in range(0, len(events), 100):
        spark.createDataFrame(events[k : k + 100], MOVE).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([last], MOVE).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        live = sessions.live_sessions_by_doors(stream, sessions.Rules(**RULES))
        q = live.writeStream.format("memory").queryName(f"doors{seed}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        if provider:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    got = rows(spark.table(f"doors{seed}"))
    assert got == rows(sessions.sessions_by_doors(spark.createDataFrame(events, MOVE), sessions.Rules(**RULES)))
    assert len(got) > 40 and any(r[6] for r in got) and any(r[7] for r in got) and any(r[5] is None for r in got)
    assert max(held) > 10 and held[-1] <= 3, held  # what is left is the sentinel's: a visit or waiting event, and its timer


def test_of_nothing(spark):
    none = spark.createDataFrame([], MOVE)
    assert sessions.sessions_by_doors(none, sessions.Rules()).count() == 0
    assert sessions.sessions_by_doors(none.unionByName(spark.createDataFrame([(*move(0, direction="in")[:1], None, *move(0)[2:])], MOVE)), sessions.Rules()).count() == 0
    assert sessions.sessions_by_doors(none.withColumn("x", F.lit(1)), sessions.Rules()).columns == [x.split()[0] for x in sessions.SESSION.split(", ")]


# ------------------------------------------------------------ tracking: staff by signs, pieces of a store
def segments(spark, rows):
    schema = "store_id string, camera_id string, local_track_id int, run long, began timestamp, left timestamp, x0 double, y0 double, x1 double, y1 double, emb0 array<double>, emb1 array<double>, staff_at timestamp"
    sec = lambda s: None if s is None else T0 + timedelta(seconds=s)
    return spark.createDataFrame([("s", cam, t, 1, sec(b), sec(e), 0.4, 0.4, 0.4, 0.4, emb, emb, sec(staff)) for cam, t, b, e, emb, staff in rows], schema)


def who(spark, rows, edges=None):
    from aislelens.streaming import tracking

    return {(r["camera_id"], r["local_track_id"]): (r["global_id"], r["how"]) for r in tracking.resolve_identities(segments(spark, rows), edges or {}).collect()}


def test_staff_by_signs_are_nobody_elses(spark):
    a, edge = [1.0, 0.0], {("A", "B"): "P0"}
    free = who(spark, [("A", 1, 0, 10, a, None), ("B", 7, 30, 40, a, None)], edge)
    assert free["B", 7] == (free["A", 1][0], "matched")
    signed = who(spark, [("A", 1, 0, 10, a, 5), ("B", 7, 30, 40, a, None)], edge)
    assert signed["B", 7][1] == "new"  # no visitor is matched with staff, nor the one at hand
    lost = who(spark, [("A", 1, 0, 10, a, None), ("A", 9, 15, 20, [0.9, 0.1], None)])
    assert lost["A", 9] == (lost["A", 1][0], "recovered")
    assert who(spark, [("A", 1, 0, 10, a, 5), ("A", 9, 15, 20, [0.9, 0.1], None)])["A", 9][1] == "new"
    late = who(spark, [("A", 1, 0, 10, a, None), ("B", 7, 30, 60, a, 50), ("A", 3, 70, 80, a, None)], edge)
    assert late["B", 7][0] == late["A", 1][0] and late["A", 3][1] == "new"


def test_store_in_pieces_equals_the_store_whole(spark, monkeypatch):
    from aislelens.streaming import tracking

    rng = np.random.default_rng(3)
    faces, t, rows = rng.normal(size=(5, 8)), 0.0, []
    for k in range(120):
        t += float(rng.choice([1, 10, 60, 3000]))
        rows.append((str(rng.choice(["A", "B", "C"])), k, t, t + float(rng.choice([0, 5, 4000], p=[0.2, 0.7, 0.1])), [float(x) for x in faces[rng.integers(5)] + rng.normal(0, 0.3, 8)], t + 1 if rng.random() < 0.1 else None))
    edges = {("A", "B"): "P0", ("B", "C"): "P1"}
    pieces = who(spark, rows, edges)
    whole = tracking.chains
    monkeypatch.setattr(tracking, "chains", lambda df, by, at, ties, gap: whole(df, by, at, ties, 1e12))
    assert who(spark, rows, edges) == pieces and len({g for g, _ in pieces.values()}) < 120


def test_person_events_of_staff(spark):
    from aislelens.streaming import tracking

    rows = [("s", "p", "A", 1, T0 + timedelta(minutes=m), z, z, k, d, None, st) for m, z, k, d, st in ((0, "entry_threshold", "enter", "in", False), (5, "browse", "enter", None, False), (20, "browse", "enter", None, True), (25, "browse", "exit", None, True))]
    df = spark.createDataFrame(rows, "store_id string, global_id string, camera_id string, local_track_id int, ts timestamp, zone_id string, zone_type string, kind string, direction string, dwell_ms long, is_staff boolean")
    (s,) = tracking.session_rows(tracking.person_events(df)).collect()
    assert s["staff"] is True and s["ended_at"] == T0 + timedelta(minutes=20) and s["started_at"] == T0


def test_frames_are_counted_on(spark):
    from aislelens.streaming import jobs

    f = spark.range(0, 250_001, 7).select(F.lit("s").alias("store_id"), F.lit("A").alias("camera_id"), F.col("id").alias("frame_index"), F.lit(T0).alias("ts"))
    got = sorted(r["frame_index"] for r in jobs.emitted_frames(f, 30).collect())
    assert got == list(range(0, 250_001, 7 * 30))


def test_events_of_tracks_and_zones(spark):
    import json
    import uuid

    from aislelens.streaming import events, tracking

    rows = [("s", "p", "A", 1, T0, "door", "entry_threshold", "enter", "in", None, False, 0.25, 0.5), ("s", "p", "A", 1, T0 + timedelta(seconds=5), "hid", "ignore", "enter", None, None, False, 0.3, 0.5)]
    df = spark.createDataFrame(rows, "store_id string, global_id string, camera_id string, local_track_id int, ts timestamp, zone_id string, zone_type string, kind string, direction string, dwell_ms long, is_staff boolean, foot_x double, foot_y double")
    (e,) = tracking.envelopes(tracking.person_events(df), "t", "c", names={"door": "Main door"}).collect()
    body = json.loads(e["payload"])
    assert body["zone_name"] == "Main door" and body["position"] == {"x": 0.25, "y": 0.5, "space": "normalized"} and body["session_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "session:s:p:1")) and body["is_store_entry"] is True
    runs = segments(spark, [("A", 1, 0, 10, [1.0], None)]).withColumn("global_id", F.lit("p")).withColumn("is_staff", F.lit(True)).withColumn("session_no", F.lit(2))
    (e,) = events.track_ended_events(runs, "t", "c").collect()
    body = json.loads(e["payload"])
    assert e["event_type"] == "vision.track.ended" and e["idempotency_key"] == "track-ended-s:p-A-1" and e["event_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, e["idempotency_key"])) and e["occurred_at"] == "2024-01-01T10:00:10Z"
    assert (body["first_seen"], body["last_seen"], body["class_label"], body["session_id"]) == ("2024-01-01T10:00:00Z", "2024-01-01T10:00:10Z", "staff", str(uuid.uuid5(uuid.NAMESPACE_URL, "session:s:p:2")))
    f = spark.createDataFrame([("s", "A", k, T0 + timedelta(seconds=k), t, f"g{t}", (0.1,), 0.9, t == 2) for k in range(7) for t in (1, 2)], "store_id string, camera_id string, frame_index long, ts timestamp, local_track_id int, global_id string, bbox struct<x: double>, confidence double, is_staff boolean")
    got = {r["idempotency_key"]: json.loads(r["payload"]) for r in events.frame_events(f, "run", "t", "c", 3).collect()}
    assert set(got) == {f"frame-A-{k}-run" for k in (0, 3, 6)} and [t["external_track_id"] for t in got["frame-A-3-run"]["tracks"]] == ["s:g1", "s:g2"] and got["frame-A-3-run"]["detections"][1] == {"detection_id": got["frame-A-3-run"]["tracks"][1]["detection_id"], "class_external_id": "staff", "bbox": {"x": 0.1}, "confidence": 0.9}
