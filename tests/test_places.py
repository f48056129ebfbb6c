"""As-of joins, zone membership, and moves folded in columns, against plain versions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislelens import queries as retail
from aislelens.operators import asof, geometry, moves, sales
from aislelens.sources import readers
from aislelens.streaming import jobs

T0 = datetime(2024, 1, 1, 10)


# ------------------------------------------------------------ as-of
@pytest.mark.parametrize("seed", range(2))
def test_nearest_brute(spark, seed):
    rng = np.random.default_rng(seed)
    left = [(i, str(rng.choice(["a", "b", "c"])), int(rng.integers(0, 400)) if rng.random() > 0.1 else None) for i in range(150)] + [(999, None, 5)]
    right = [(k, str(rng.choice(["a", "b"])), int(rng.integers(0, 400)) if rng.random() > 0.1 else None) for k in range(80)] + [(500, None, 5), (3, "a", 7), (2, "a", 7)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges
    try:
        a, b = spark.createDataFrame(left, "i long, s string, at_ long"), spark.createDataFrame(right, "k long, s string, t long")
        got = {r["i"]: tuple(r["hit"]) if r["hit"] else None for r in asof.nearest(a.withColumnRenamed("at_", "at"), b, ["s"], "at", "t", ["k"], 25).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, s, at in left:
        near = [(abs(t - at), k) for k, rs, t in right if s is not None and rs == s and t is not None and at is not None and abs(t - at) <= 25]
        assert got[i] == min(near, default=None)
    assert len(got) == len(left)


def test_asof_sides(spark):
    a = spark.createDataFrame([(1, "s", 10), (2, "s", 20), (3, "t", 10)], "i long, s string, at long")
    b = spark.createDataFrame([("x", "s", 10), ("y", "s", 15), ("z", "s", 30)], "k string, s string, t long")
    got = {r["i"]: (r["before"] and r["before"]["k"], r["after"] and r["after"]["k"]) for r in asof.asof(a, b, ["s"], "at", "t", ["k"]).collect()}
    assert got == {1: ("x", "y"), 2: ("y", "z"), 3: (None, None)}
    assert asof.asof(a.where("false"), b, ["s"], "at", "t", ["k"]).count() == 0
    assert [r["before"] for r in asof.asof(a, b.where("false"), ["s"], "at", "t", ["k"]).collect()] == [None] * 3


def test_nearest_order_multiplies_no_row(spark):
    """The plan has no join of tracks with orders: one of tracks with ranges only."""
    bills = spark.createDataFrame([("s", f"t{k}", T0 + timedelta(minutes=k)) for k in range(50)], "store_id string, external_track_id string, billing_at timestamp_ntz")
    tx = spark.createDataFrame([(k, "s", "completed", T0 + timedelta(minutes=k, seconds=5)) for k in range(50)], "transaction_id long, store_id string, status string, occurred_at timestamp_ntz")
    got = sales.nearest_order(bills, tx, 86400)
    assert {r["external_track_id"]: (r["transaction_id"], r["delta_s"]) for r in got.collect()} == {f"t{k}": (k, 5.0) for k in range(50)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "range_no" in next(x for x in plan.split("\n") if "Join" in x)


# ------------------------------------------------------------ links of a store that never rests
def test_links_in_ranges_equal_the_loop(spark):
    rng = np.random.default_rng(4)
    bills = [(str(s), f"t{k:05d}", T0 + timedelta(seconds=float(x))) for s in "ab" for k, x in enumerate(np.sort(rng.uniform(0, 20_000, 700)))]
    sold = [(k, str(s), "completed", T0 + timedelta(seconds=round(float(x), 1))) for s, o in (("a", 0), ("b", 1)) for k, x in enumerate(rng.uniform(0, 20_000, 650), 1000 * o)]
    b = spark.createDataFrame(bills, "store_id string, external_track_id string, billing_at timestamp_ntz")
    t = spark.createDataFrame(sold, "transaction_id long, store_id string, status string, occurred_at timestamp_ntz")
    got = {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (100, 1_000_000):
            got[most] = sorted((r["store_id"], r["external_track_id"], r["transaction_key"], r["confidence"]) for r in sales.link_orders(b, t, 300, mode="TIME_WINDOW", most=most).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for s in "ab":
        left = sorted(((at - T0).total_seconds(), str(k)) for k, x, _, at in sold if x == s)
        for _, track, at in sorted((r for r in bills if r[0] == s), key=lambda r: (r[2], r[1])):
            at = (at - T0).total_seconds()
            near = [(abs(o - at), o, k) for o, k in left if abs(o - at) <= 300]
            if near:
                d, o, k = min(near)
                left.remove((o, k))
                want.append((s, track, k, round(1 - d / 300, 3)))
    assert got[100] == sorted(want) == got[1_000_000] and len(want) > 1000


# ------------------------------------------------------------ polygons
def star(rng, n):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r, c = rng.uniform(0.02, 0.6, n), rng.uniform(-0.5, 1.5, 2)
    return [[float(c[0] + k * np.cos(a)), float(c[1] + k * np.sin(a))] for a, k in zip(angle, r, strict=True)]


@pytest.mark.parametrize("seed", range(2))
def test_membership_brute(spark, seed):
    rng = np.random.default_rng(seed)
    zones = {f"c{k}": [{"zone_id": f"z{j}", "points": star(rng, int(rng.integers(3, 12)))} for j in range(4)] for k in range(2)}
    zones["c0"] += [{"zone_id": "flat", "points": [[0.1, 0.5], [0.9, 0.5], [0.9, 0.5 + 1e-8], [0.1, 0.5 + 1e-8]]}, {"zone_id": "two", "points": [[0.0, 0.0], [1.0, 1.0]]}, {"zone_id": "huge", "points": [[-900.0, -900.0], [900.0, -900.0], [0.3, 900.0]]}]
    zones["c1"] += [{"zone_id": "box", "points": [[0.25, 0.25], [0.5, 0.25], [0.5, 0.5], [0.25, 0.5]]}, {"zone_id": "knot", "points": [[0, 0], [1, 1], [1, 0], [0, 1]]}]
    spots = [(f"c{rng.integers(0, 3)}", float(x), float(y)) for x, y in np.concatenate([rng.uniform(-1, 2, (1500, 2)), rng.integers(-8, 40, (1500, 2)) / 32])] + [("c0", None, 0.5), ("c0", 0.5, None), (None, 0.5, 0.5), ("c1", 0.5, 0.5 + 1e-8), ("c0", 0.5, 0.5 + 5e-9)]
    points = spark.createDataFrame([(i, *p, "clash", 7) for i, p in enumerate(spots)], "i long, camera_id string, foot_x double, foot_y double, points string, cx int")
    got = sorted((r["i"], r["zone_id"]) for r in geometry.zone_membership(points, readers.zones_frame(spark, zones)).collect())
    want = sorted((i, z["zone_id"]) for i, (c, x, y) in enumerate(spots) if x is not None and y is not None for z in zones.get(c, []) if len(z["points"]) > 2 and jobs.inside(z["points"], x, y))
    assert got == want and len(want) > 300


def test_grid_is_bounded_and_decides_most_points(spark):
    zones = {"c": [{"zone_id": "big", "points": [[0.0, 0.0], [5000.0, 0.0], [5000.0, 5000.0], [0.0, 5000.0]]}, {"zone_id": "small", "points": [[0.1, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.9]]}]}
    index = geometry.grid_index(readers.zones_frame(spark, zones))
    by = {r["zone_id"]: r for r in index.groupBy("zone_id").agg(F.count("*").alias("n"), F.sum(F.col("whole").cast("int")).alias("whole")).collect()}
    assert all(r["n"] <= (geometry.MOST_CELLS + 2) ** 2 for r in by.values()) and by["small"]["whole"] > 0.7 * by["small"]["n"]
    plan = geometry.zone_membership(spark.createDataFrame([("c", 0.5, 0.5)], "camera_id string, foot_x double, foot_y double"), readers.zones_frame(spark, zones))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


# ------------------------------------------------------------ moves
def walk(rng, n, step_ms):
    t, x, y, out = 0, rng.uniform(0, 1), rng.uniform(0, 1), []
    for _ in range(n):
        t += int(rng.integers(1, step_ms))
        x, y = (float(np.clip(v + rng.normal(0, 0.04 if rng.random() < 0.7 else 0.004), 0, 1)) for v in (x, y))
        out.append((T0 + timedelta(milliseconds=t), x, y))
    return out


@pytest.mark.parametrize(("seed", "step_ms"), [(0, 200), (1, 900), (2, 4000)])
def test_moves_equal_the_state_machine(spark, seed, step_ms):
    rng = np.random.default_rng(seed)
    rows = [("s", f"CAM{cam}", track, run, *p) for cam in range(1, 7) for track in range(6) for run in range(2) for p in walk(rng, 120, step_ms)]
    frames = spark.createDataFrame(rows, "store_id string, camera_id string, local_track_id int, run long, ts timestamp, foot_x double, foot_y double").repartition(3)
    cols = ["store_id", "camera_id", "local_track_id", "run", "ts", "zone_id", "zone_type", "kind", "direction", "dwell_ms"]
    told = lambda df: sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    got, want = told(moves.zone_moves(frames, retail.ZONES)), told(jobs.zone_moves(frames, retail.ZONES))
    # Both tell a move's time: ours in ms, as dwell is.
    assert got == [(*r[:4], r[4].replace(microsecond=r[4].microsecond // 1000 * 1000), *r[5:]) for r in want]
    assert len(got) > 100 and {r[7] for r in got} == {"enter", "exit"} and {"in", "out"} <= {r[8] for r in got}


def test_moves_keep_few_frames(spark):
    """A person who stands still for an hour is a few sights, not a row for each frame."""
    rows = [("s", "CAM2", 1, 0, T0 + timedelta(milliseconds=100 * k), 0.1 if k > 50 else 0.99, 0.2) for k in range(36_000)]
    frames = spark.createDataFrame(rows, "store_id string, camera_id string, local_track_id int, run long, ts timestamp, foot_x double, foot_y double")
    assert moves.changes_of_sight(frames, retail.ZONES).count() < 60
    assert [(r["zone_id"], r["kind"]) for r in moves.zone_moves(frames, retail.ZONES).collect()] == [("shelf-a", "enter")]
    assert moves.zone_moves(frames.where("false"), retail.ZONES).count() == 0
    with pytest.raises(ValueError, match="no camera"):
        moves.zone_moves(frames, {})


def test_debounce_over_cameras(spark):
    def move(s, cam, zone, who, kind="enter", direction=None):
        return ("s", cam, zone, who, T0 + timedelta(seconds=s), kind, direction)

    rows = [
        move(0, "A", "q", "p"), move(2, "B", "q", "p"), move(3.0, "A", "q", "p"), move(3.5, "B", "q", "p"), move(1, "B", "q", "other"), move(1, "B", "r", "p"), move(1, "A", "q", "p", "exit"), move(0, "A", "q", None), move(0.1, "A", "q", None),
        move(10, "A", "d", "p", direction="in"), move(11.9, "B", "d", "p", direction="out"), move(12.0, "B", "d", "p", direction="out"), move(12.1, "A", "d", "p", direction="in"), move(12.2, "A", "d", "p"),
    ]
    df = spark.createDataFrame(rows, "store_id string, camera_id string, zone_id string, global_id string, ts timestamp, kind string, direction string")
    got = sorted(((r["ts"] - T0).total_seconds(), r["zone_id"], r["global_id"] or "", r["kind"], r["direction"] or "") for r in moves.debounced(df).collect())
    assert got == sorted([(0, "q", "p", "enter", ""), (3.5, "q", "p", "enter", ""), (1, "q", "other", "enter", ""), (1, "r", "p", "enter", ""), (1, "q", "p", "exit", ""), (0, "q", "", "enter", ""), (0.1, "q", "", "enter", ""), (10, "d", "p", "enter", "in"), (12.1, "d", "p", "enter", "in"), (12.2, "d", "p", "enter", "")])
