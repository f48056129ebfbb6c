"""Visitors' sessions by door events: one step for batch and stream, and the stream's processor with named states and timers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed values, in seconds: a session resumes within GAP_S of its end, a track found again within MERGE_S of the last sight goes on with it; who is not seen for TTL_S is forgotten.
GAP_S, MERGE_S, TTL_S = 1800.0, 45.0, 2700.0
SESSION = "store_id string, global_id string, session_no int, started_at timestamp, last_at timestamp, ended_at timestamp, is_reentry boolean, staff boolean"
_EVENT = "at long, camera_id string, zone_type string, kind string, direction string, is_staff boolean"
_COLUMNS = [x.split()[0] for x in _EVENT.split(", ")]


class Rules:
    """How sessions begin and end, and which enters another camera tells already.

    suppress: {suppress_camera, suppress_zone_types, active_camera, active_zone_types, within_seconds}.
    """

    def __init__(self, suppress: list[dict] | None = None, roles: dict[str, str] | None = None, gap_s: float = GAP_S, merge_s: float = MERGE_S, ttl_s: float = TTL_S):
        self.suppress, self.roles = suppress or [], roles or {}
        self.gap, self.merge, self.ttl = (int(s * 1e6) for s in (gap_s, merge_s, ttl_s))

    def hidden(self, active: dict[str, list[int]], camera: str, zone_type: str, at: int) -> bool:
        """(ST-08)"""
        return any(
            camera == r["suppress_camera"] and zone_type in r["suppress_zone_types"]
            and any(at - since <= r["within_seconds"] * 1e6 for z in r["active_zone_types"] for since in active.get(f"{r['active_camera']}|{z}", ()))
            for r in self.suppress
        )


def nobody() -> dict[str, Any]:
    """State of a person: number of the session, its begin, end and last event, if it runs, is a re-entry or staff's; when the person was last seen, and enters that are not left yet."""
    return {"no": 0, "began": None, "ended": None, "last": None, "running": False, "again": False, "staff": False, "seen": None, "latest": None, "active": {}}


def session_row(key: tuple, s: dict[str, Any]) -> tuple:
    stamp = lambda us: None if us is None else pd.Timestamp(us, unit="us")
    return (*key, s["no"], stamp(s["began"]), stamp(s["last"]), None if s["running"] else stamp(s["ended"]), s["again"], s["staff"])


def _row(key: tuple, s: dict[str, Any]) -> Row:
    return Row(**dict(zip((x.split()[0] for x in SESSION.split(", ")), session_row(key, s), strict=True)))


def visit_step(s: dict[str, Any], rules: Rules, at: int, camera: str, zone_type: str | None, kind: str, direction: str | None, staff: bool) -> tuple[dict[str, Any] | None, dict[str, Any]]:
    """(a session that is over for good, what the event means); `s` is changed. Times are in microseconds. (ST-04, ST-12)

    kind: enter or exit of a zone, recovered (a track found again), staff (behaviour tells).
    An enter over the threshold begins or resumes a session, as does one into a door zone of an
    entry camera where none runs; going out ends it. Staff's session ends and is marked. A track
    found again soon after the person was last seen takes the session up, also one just ended.
    Only door events, staff signs and such tracks count as seeing the person.
    """
    over = None
    if s["latest"] is not None and at - s["latest"] > rules.ttl:
        over = dict(s) if s["no"] else None
        s.clear()
        s.update(nobody())
    s["latest"] = at
    enter = kind == "enter"
    told = {"hidden": enter and rules.hidden(s["active"], camera, zone_type, at), "again": False, "out": False, "session": None, "began": None}

    def resume() -> None:
        s["running"], s["ended"], s["seen"], s["last"] = True, None, at, at

    def close() -> None:
        s["running"], s["ended"], s["seen"], s["last"] = False, at, at, at

    belongs = s["running"]
    if kind == "recovered":
        if s["running"]:
            s["seen"] = at
        elif s["no"] and s["seen"] is not None and at - s["seen"] <= rules.merge and at - s["ended"] <= rules.gap:
            resume()
            belongs = True
    elif staff and s["running"] and (kind == "staff" or zone_type != "staff_only"):
        s["staff"] = True
        close()
    elif not staff and not told["hidden"]:
        comes = enter and zone_type == "entry_threshold" and direction == "in"
        door = enter and not s["running"] and rules.roles.get(camera) == "entry" and zone_type in ("entrance", "entry_threshold") and direction != "out"
        told["out"] = enter and zone_type == "entry_threshold" and direction == "out"
        if comes and s["running"]:
            s["seen"] = at
        elif comes or door:
            belongs = True
            if s["no"] and at - s["ended"] <= rules.gap:
                resume()
            else:
                told["again"] = s["no"] > 0
                over = dict(s) if s["no"] else over
                s.update(no=s["no"] + 1, began=at, again=told["again"], staff=False)
                resume()
        elif told["out"] and s["running"]:
            close()
    if not told["hidden"]:
        spot = f"{camera}|{zone_type}"
        if enter:
            s["active"].setdefault(spot, []).append(at)
        elif kind == "exit":
            s["active"].pop(spot, None)
    if belongs:
        s["last"] = at
        told["session"], told["began"] = s["no"], s["began"]
    return over, told


def _events(moves: DataFrame) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return moves.select("store_id", "global_id", at.alias("at"), "camera_id", "zone_type", "kind", "direction", F.coalesce("is_staff", F.lit(False)).alias("is_staff"))


def _ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0], *(str(x) for x in r[1:])))


def sessions_by_doors(moves: DataFrame, rules: Rules) -> DataFrame:
    """Sessions (SESSION) of moves (store_id, global_id, ts, camera_id, zone_type, kind, direction, is_staff), a person's in order. (ST-04, ST-12)"""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = nobody(), []
        clean = pdf.astype(object).where(pdf.notna(), None)
        for row in _ordered(list(clean[_COLUMNS].itertuples(index=False, name=None))):
            over, _ = visit_step(s, rules, int(row[0]), *row[1:])
            out += [session_row(key, over)] if over else []
        out += [session_row(key, s)] if s["no"] else []
        return pd.DataFrame(out, columns=[x.split()[0] for x in SESSION.split(", ")])

    return _events(moves.where("global_id is not null")).groupBy("store_id", "global_id").applyInPandas(run, SESSION)


class DoorSessions(StatefulProcessor):
    """Keeps, for each person of a store: `visit`, what is known so far, and `waiting`, events that an earlier one may still come before."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visit = handle.getValueState("visit", "json string")
        self.waiting = handle.getListState("waiting", _EVENT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        yield from self._advance(key, [tuple(r[c] for c in _COLUMNS) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, new: list[tuple], watermark_ms: int) -> Iterator[Row]:
        """Folds what no earlier event can come before any more; the rest waits for its time. State goes once the person is forgotten."""
        key = tuple(key)
        s = json.loads(self.visit.get()[0]) if self.visit.exists() else nobody()
        events = _ordered([*(tuple(r) for r in self.waiting.get()), *new]) if self.waiting.exists() else _ordered(new)
        ready = [e for e in events if e[0] <= watermark_ms * 1000]
        later = events[len(ready) :]
        for e in ready:
            if s["latest"] is None or e[0] >= s["latest"]:
                over, _ = visit_step(s, self.rules, int(e[0]), *e[1:])
                if over:
                    yield _row(key, over)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        forget_ms = None if s["latest"] is None else (s["latest"] + self.rules.ttl) // 1000 + 1
        if not later and (forget_ms is None or forget_ms <= watermark_ms):
            if s["no"]:
                yield _row(key, s)
            self.visit.clear()
            self.waiting.clear()
            return
        self.visit.update((json.dumps(s),))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        self.handle.registerTimer(max(watermark_ms + 1, later[0][0] // 1000 + 1 if later else forget_ms))

    def close(self) -> None:
        pass


def live_sessions_by_doors(moves: DataFrame, rules: Rules, delay: str = "10 minutes") -> DataFrame:
    """The stream of sessions_by_doors(): a session comes out once it is over for good, that is when the next one begins or the person is forgotten. (ST-04, ST-12)

    Events may come out of order by `delay`: they wait until the watermark has passed them.
    A person's state is dropped TTL_S after the last event. The state store has to be RocksDB,
    which this sets for the session.
    """
    moves.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    marked = moves.where("global_id is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    events = marked.select("store_id", "global_id", "ts", F.unix_micros("ts").alias("at"), "camera_id", "zone_type", "kind", "direction", F.coalesce("is_staff", F.lit(False)).alias("is_staff"))
    return events.groupBy("store_id", "global_id").transformWithState(statefulProcessor=DoorSessions(rules), outputStructType=SESSION, outputMode="append", timeMode="EventTime")
