"""Structured Streaming: deduplicated ingest, hourly rollup, live sessions, the track state machine."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import columns as C
from ..operators.ordered import ranked


def deduplicated(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """First delivery of each idempotency key. (ST-16)"""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def hourly_footfall(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Tumbling hours of customer entries. (ST-17)"""
    e = events.where((F.col("event_type") == C.ENTERED) & C.is_customer_event()).withWatermark("occurred_at", delay)
    return e.groupBy(F.window("occurred_at", "1 hour"), "store_id").agg(F.count("*").alias("value")).select("store_id", F.col("window.start").alias("bucket_start"), "value")


def sampled(frames: DataFrame, native_fps: float, sample_fps: float) -> DataFrame:
    """Every n-th frame. (ST-14)"""
    return frames.where(F.col("frame_index") % max(1, round(native_fps / sample_fps)) == 0)


def upsert_each_batch(write: Callable[[DataFrame, int], None]):
    """foreachBatch target that hands each micro-batch to an upsert. (ST-18)"""
    return lambda df, epoch: write(df.withColumn("load_no", F.lit(epoch).cast("long")), epoch)


#: A stream forgets a track without frames after this long.
FORGET_MS = 60_000
SESSION = "store_id string, external_track_id string, session_no long, started_at timestamp, ended_at timestamp, n_events long, is_reentry boolean"


def live_sessions(events: DataFrame, cooldown_s: int = 1800) -> DataFrame:
    """Sessions of a store's track that close after `cooldown_s` without events. (ST-04, ST-10)

    State is four numbers a track; an event-time timeout closes the session, and a second one,
    as long again, forgets the track. Sessions by doors are in sessions.py.
    """
    wait_ms = cooldown_s * 1000

    def step(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, end, n = state.get if state.exists else (0, None, None, 0)
        closed = []

        def close() -> None:
            closed.append((*key, number, pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), n, number > 1))

        if state.hasTimedOut:
            if end is None:
                state.remove()
            else:
                close()
                state.update((number, None, None, 0))
                state.setTimeoutTimestamp(max(end // 1000 + 2 * wait_ms, state.getCurrentWatermarkMs() + 1))
        else:
            times = sorted(int(t.value // 1000) for f in frames for t in f["occurred_at"])
            for t in times:
                if end is not None and t - end > cooldown_s * 1_000_000:
                    close()
                    start = None
                if start is None:
                    number, start, n = number + 1, t, 0
                end, n = t, n + 1
            state.update((number, start, end, n))
            at = (end + cooldown_s * 1_000_000) // 1000 + 1
            if at > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(at)
        yield pd.DataFrame(closed, columns=["store_id", "external_track_id", "session_no", "started_at", "ended_at", "n_events", "is_reentry"])

    return (
        events.withWatermark("occurred_at", "10 minutes").groupBy("store_id", "external_track_id")
        .applyInPandasWithState(step, SESSION, "number long, start long, end long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    )


# ------------------------------------------------------------ per-track zones, the same code for batch and stream
MOVES = "store_id string, camera_id string, local_track_id int, run long, ts timestamp, zone_id string, zone_type string, kind string, direction string, dwell_ms long, is_staff boolean, staff_reason string, foot_x double, foot_y double"
# Slack of polygons and lines, and times of debouncing, in the frame's units and seconds.
POLYGON_SLACK, LINE_SLACK, LEAST_WAY, LEAST_DWELL_MS, SAME_TYPE_S, LINE_S, AFTER_S = 0.012, 0.008, 0.015, 500, 3.0, 2.0, 15.0
# Signs of staff.
DARK_SHARE, DARK_FRAMES, DARK_FRAMES_BILLING, PRESENT_S, PRESENT_BILLING_S = 0.70, 60, 30, 900.0, 180.0
ZONE_STAY_S = {"staff_only": 300.0, "billing_queue": 120.0, "checkout": 120.0, "consultation": 600.0}
SHUTTLES, SHUTTLE_CYCLES, VISITS_KEPT = (("consultation", "aisle"), ("billing_queue", "aisle")), 3, 24
POINTS_KEPT, LOITER_POINTS, LOITER_PATH, LOITER_RATIO, LEAST_NET = 120, 30, 0.15, 4.0, 0.005


def inside(points: list[list[float]], x: float, y: float) -> bool:
    """Even-odd rule; columns.in_polygon() is the same for columns."""
    odd = False
    for (ax, ay), (bx, by) in zip(points, [*points[-1:], *points[:-1]], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay + 1e-9) + ax:
            odd = not odd
    return odd


def shrunk(points: list[list[float]], by: float) -> list[list[float]]:
    """A polygon drawn in about the mean of its vertices: the part of a zone that is surely inside."""
    mx, my = (sum(p[k] for p in points) / len(points) for k in (0, 1))
    return [[mx + (x - mx) * (1 - by), my + (y - my) * (1 - by)] for x, y in points]


def new_state() -> dict:
    """What is known of a track: since when in which zone, last enters by type, sides of lines, crossings, way, visits, dark frames, since when, reason of staff."""
    return {"in": {}, "enter": {}, "side": {}, "cross": {}, "raw": [], "points": [], "path": 0.0, "visits": [], "dark": 0, "first": None, "staff": None}


def polygon_step(s: dict, z: dict, ms: int, x: float, y: float, now: set[str]) -> tuple[str, int | None] | None:
    """An enter or exit of one polygon. In counts at the edge, out only beyond the slack and after LEAST_DWELL_MS; enters that repeat are swallowed. (ST-05, ST-07, W-06)"""
    zid, kind = z["zone_id"], z["zone_type"]
    if zid in s["in"]:
        if inside(shrunk(z["points"], POLYGON_SLACK), x, y) or ms - s["in"][zid] < LEAST_DWELL_MS:
            return None
        return "exit", ms - s["in"].pop(zid)
    if not inside(z["points"], x, y):
        return None
    before = z.get("require_prior_zone_types")
    if before and not any(t in s["enter"] for t in before):
        return None
    s["in"][zid] = ms
    after, wait = z.get("dedupe_after_zone_types") or (), 1000 * z.get("dedupe_after_seconds", AFTER_S)
    if now & set(after) or any(ms - s["enter"][t] <= wait for t in after if t in s["enter"]) or ms - s["enter"].get(kind, -(10**15)) <= 1000 * SAME_TYPE_S:
        return None
    s["enter"][kind] = ms
    return "enter", None


def line_step(s: dict, z: dict, ms: int, x: float, y: float) -> str | None:
    """in or out over a line: the side has to change by more than the slack, with a way across, and not again at once. (ST-06)"""
    zid, (a, b), normal = z["zone_id"], z["points"][:2], z.get("direction_normal")
    unit = C.line_normal(tuple(a), tuple(b), tuple(normal) if normal else None)
    across = normal or unit
    side = (x - a[0]) * across[0] + (y - a[1]) * across[1]
    sign = (side > LINE_SLACK) - (side < -LINE_SLACK)
    was, s_raw = s["side"].get(zid, 0), s["raw"]
    if sign == 0:
        return None
    if was * sign >= 0:
        s["side"][zid] = sign
        return None
    if zid in s["cross"] and ms - s["cross"][zid] < 1000 * LINE_S:
        s["side"][zid] = sign
        return None
    if s_raw and abs((x - s_raw[0]) * unit[0] + (y - s_raw[1]) * unit[1]) < LEAST_WAY:
        return None
    way = "in" if sign > was else "out"
    s["cross"][zid], s["side"][zid] = ms, sign
    if way == "in" and ms - s["enter"].get(z["zone_type"], -(10**15)) <= 1000 * SAME_TYPE_S:
        return None
    s["enter"][z["zone_type"]] = ms
    return way


def staff_sign(s: dict, ms: int, x: float, y: float, dark: float, role: str, types: dict[str, str]) -> str | None:
    """Why a track is staff, if it is. (ST-09)"""
    if s["points"]:
        s["path"] += math.hypot(x - s["points"][-1][0], y - s["points"][-1][1])
    s["points"] = [*s["points"], [x, y]][-POINTS_KEPT:]
    if s["staff"]:
        return s["staff"]
    billing = role == "billing"
    s["dark"] = s["dark"] + 1 if dark >= DARK_SHARE else max(0, s["dark"] - 1)
    present = (ms - s["first"]) / 1000
    stay = {types[z]: (ms - t) / 1000 for z, t in s["in"].items()}
    v, p = s["visits"], s["points"]
    cycles = [sum(a != b and {a, b} <= set(pair) for a, b in zip(v, v[1:], strict=False)) for pair in SHUTTLES]
    signs = (
        ("backroom_camera", role == "backroom"), ("dark_uniform", s["dark"] >= (DARK_FRAMES_BILLING if billing else DARK_FRAMES)), ("billing_long_presence", billing and present >= PRESENT_BILLING_S),
        ("long_presence", present >= PRESENT_S), ("zone_dwell", any(stay.get(z, 0) >= most for z, most in ZONE_STAY_S.items())),
        ("repeated_shuttle", len(v) >= 2 * SHUTTLE_CYCLES and max(cycles) >= SHUTTLE_CYCLES),
        ("repeated_movement", len(p) >= LOITER_POINTS and s["path"] >= LOITER_PATH and s["path"] / max(math.hypot(p[-1][0] - p[0][0], p[-1][1] - p[0][1]), LEAST_NET) >= LOITER_RATIO),
    )
    s["staff"] = next((name for name, on in signs if on), None)
    return s["staff"]


def track_step(s: dict, zones: list[dict], role: str, ms: int, x: float, y: float, dark: float) -> list[tuple]:
    """(zone, type, kind, direction, dwell) of one frame of a track; `s` is its state."""
    s["first"] = ms if s["first"] is None else s["first"]
    found, now = [], set()
    for z in zones:
        if z.get("kind", "polygon") == "line":
            way = None if z.get("counting_only") else line_step(s, z, ms, x, y)
            got = ("enter", way, None) if way else None
        else:
            step = polygon_step(s, z, ms, x, y, now)
            got = (step[0], None, step[1]) if step else None
        if got:
            found.append((z["zone_id"], z["zone_type"], *got))
            if got[0] == "enter":
                now.add(z["zone_type"])
                if s["visits"][-1:] != [z["zone_type"]]:
                    s["visits"] = [*s["visits"], z["zone_type"]][-VISITS_KEPT:]
    s["raw"] = [x, y]
    staff_sign(s, ms, x, y, dark, role, {z["zone_id"]: z["zone_type"] for z in zones})
    return found


def zone_moves(frames: DataFrame, zones: dict[str, list[dict]], roles: dict[str, str] | None = None, signs: bool = False) -> DataFrame:
    """Zone enters, exits and crossings of frame tracks (store_id, camera_id, local_track_id, ts, foot_x, foot_y, perhaps run, dark_ratio), keyed by track. (ST-05..ST-07, ST-09)

    A batch runs each track in time order; a stream keeps the state of a track, a few numbers,
    and forgets it when no frame came for a while. Frames inside zones marked
    exclude_detections are left out. A stream gives what the batch gives if frames come in order.
    signs: a row of kind staff tells when behaviour first says that a track is staff.
    """
    roles = roles or {}
    masks = {cam: [z["points"] for z in zs if z.get("exclude_detections")] for cam, zs in zones.items()}
    use = {cam: [z for z in zs if not z.get("exclude_detections")] for cam, zs in zones.items()}
    for name, value in (("run", F.lit(0).cast("long")), ("dark_ratio", F.lit(0.0))):
        frames = frames if name in frames.columns else frames.withColumn(name, value)

    def run(key: tuple, rows: pd.DataFrame, state: dict) -> pd.DataFrame:
        out = []
        for r in rows.sort_values("ts", kind="stable").itertuples():
            if any(inside(m, r.foot_x, r.foot_y) for m in masks.get(key[1], ())):
                continue
            was = state["staff"]
            found = track_step(state, use.get(key[1], []), roles.get(key[1], ""), int(r.ts.value // 1_000_000), float(r.foot_x), float(r.foot_y), float(r.dark_ratio or 0))
            if signs and state["staff"] and not was:
                found = [(None, None, "staff", None, None), *found]
            out += [(key[0], key[1], int(key[2]), int(key[3]), r.ts, *move, state["staff"] is not None, state["staff"], float(r.foot_x), float(r.foot_y)) for move in found]
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in MOVES.split(", ")])
        return frame.astype({"dwell_ms": "Int64"})

    keys = ["store_id", "camera_id", "local_track_id", "run"]
    if not frames.isStreaming:
        return frames.groupBy(*keys).applyInPandas(lambda key, pdf: run(key, pdf, new_state()), MOVES)

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else new_state()
        got = run(key, pd.concat(list(parts)), state)
        held.update((json.dumps(state),))
        held.setTimeoutDuration(FORGET_MS)
        yield got

    return frames.groupBy(*keys).applyInPandasWithState(step, MOVES, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def snapshot_every(df: DataFrame, write: Callable[[DataFrame, int], None], seconds: int = 5):
    """A stream writer that hands what is new to `write` every few seconds. (ST-19)"""
    return df.writeStream.foreachBatch(write).trigger(processingTime=f"{seconds} seconds")


def emitted_frames(frames: DataFrame, every: int = 30) -> DataFrame:
    """Every n-th sampled frame of a camera gives a frame event; frames are numbered in time ranges. (ST-14)"""
    seen = frames.select("store_id", "camera_id", "frame_index", "ts").dropDuplicates(["store_id", "camera_id", "frame_index"])
    return ranked(seen, ["store_id", "camera_id"], ["frame_index"], "n").where((F.col("n") - 1) % every == 0).drop("n")
