"""From frame tracks to events, as Spark stages keyed ever more finely.

1. segments(): a local track's unbroken run of frames, one row each (windows over one track);
2. resolve_identities(): who each segment is, in time order (a store is cut where nothing begins or ends for so long that nobody is remembered);
3. zone_moves() in jobs: enters, exits, crossings and staff signs (one group a segment);
   a run's staff sign comes from here, so this goes before identities where signs matter;
4. person_events(): overlap suppression and sessions (one group a person);
5. envelopes(): events to ingest, as columns.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.ordered import chains, settled
from .events import zone_events
from .sessions import GAP_S, Rules, nobody, sessions_by_doors, visit_step

# Gates, thresholds and times of identity matching.
COSINE_GATE, SAME_CAMERA_GATE, THRESHOLD, THRESHOLD_BLIND, TTL_S, BLEND = 0.55, 0.40, 0.68, 0.58, 2700.0, 0.35
RECOVERY_S, RECOVERY_FOOT, RECOVERY_SCORE, BLIND_COSINE = 20.0, 0.18, 0.52, 0.45
APPAREL_BINS = 48
_SPACE = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")


def segments(frames: DataFrame, step: int = 1) -> DataFrame:
    """frames (store_id, camera_id, local_track_id, frame_index, ts, foot_x, foot_y, embedding) -> runs of frames no more than `step` apart. (ST-10)

    A track that is missing from a frame has ended. Each run has its first and last time and
    foot point, and the first and last embedding.
    """
    keys = ["store_id", "camera_id", "local_track_id"]
    w = Window.partitionBy(*keys).orderBy("frame_index")
    new = F.coalesce((F.col("frame_index") - F.lag("frame_index").over(w) > step).cast("int"), F.lit(1))
    run = frames.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = (lambda c: F.min_by(c, "frame_index")), (lambda c: F.max_by(c, "frame_index"))
    return run.groupBy(*keys, "run").agg(
        F.min("ts").alias("began"), F.max("ts").alias("left"), first("foot_x").alias("x0"), first("foot_y").alias("y0"), last("foot_x").alias("x1"), last("foot_y").alias("y1"),
        first("embedding").alias("emb0"), last("embedding").alias("emb1"), F.count("*").alias("frames"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"),
    )


# ------------------------------------------------------------ identity
def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / ((np.linalg.norm(a) * np.linalg.norm(b)) or 1.0))


@dataclass
class Person:
    at: float
    camera: str
    emb: np.ndarray | None
    staff: bool


@dataclass
class Identities:
    """People of a store. A segment is a lost track found again on its camera, else the best match, else the only visitor at hand, else someone new."""

    edges: dict[tuple[str, str], str]  # (from, to): priority
    roles: dict[str, str] = field(default_factory=dict)
    people: dict[str, Person] = field(default_factory=dict)
    lost: list[tuple[float, str, str, float, float, np.ndarray | None]] = field(default_factory=list)

    def reach(self, src: str, dst: str) -> float:
        """Longest handoff in seconds. (F-25)"""
        priority = self.edges.get((src, dst))
        if priority == "P0":
            return C.HANDOFF_S["floor_to_billing" if self.roles.get(src) != "entry" and self.roles.get(dst) == "billing" else "entry_to_floor"]
        return C.HANDOFF_S["billing_to_backroom" if priority == "P1" else "floor_to_floor"]

    def recovered(self, camera: str, at: float, x: float, y: float, emb: np.ndarray | None) -> str | None:
        """(ST-01)"""
        self.lost = [s for s in self.lost if at - s[0] <= RECOVERY_S]
        best, score = None, 0.0
        for _, gid, cam, lx, ly, seen in self.lost:
            if cam == camera:
                alike = max(0.0, cosine(emb, seen)) if emb is not None and seen is not None else BLIND_COSINE
                s = 0.35 * max(0.0, 1 - math.hypot(x - lx, y - ly) / RECOVERY_FOOT) + 0.65 * alike
                best, score = (gid, s) if s > score else (best, score)
        if best is None or score < RECOVERY_SCORE:
            return None
        self.lost = [s for s in self.lost if s[1] != best]
        return best if best in self.people else None

    def matched(self, camera: str, at: float, emb: np.ndarray | None, staff: bool) -> tuple[str | None, float]:
        """The best match of all, or the best one on the same camera if it nearly reaches the threshold. (ST-02, J-17, F-24)"""
        need, w = THRESHOLD_BLIND if emb is None else THRESHOLD, C.MATCH_WEIGHTS
        any_, here = (None, 0.0), (None, 0.0)
        for gid, p in self.people.items():
            gap, most = at - p.at, self.reach(p.camera, camera)
            if p.staff and not staff or gap > most or emb is not None and p.emb is None:
                continue
            same = p.camera == camera
            alike = cosine(emb, p.emb) if emb is not None else 0.0
            if emb is not None and alike < (SAME_CAMERA_GATE if same else COSINE_GATE):
                continue
            graph = C.ON_EDGE if (p.camera, camera) in self.edges else C.SAME_CAMERA if same else C.OFF_EDGE
            dress = max(0.0, cosine(emb[:APPAREL_BINS], p.emb[:APPAREL_BINS])) if emb is not None else 0.0
            s = w["cosine"] * max(0.0, alike) + w["time_gap"] * max(0.0, 1 - gap / max(most, 1.0)) + w["camera_graph"] * graph + w["apparel"] * dress
            any_ = (gid, s) if s > any_[1] else any_
            here = (gid, s) if same and s > here[1] else here
        pick = here if here[0] is not None and here[1] >= 0.9 * need else any_
        return pick if pick[0] is not None and pick[1] >= need else (None, 0.0)

    def alone(self, camera: str, at: float) -> str | None:
        """The one visitor last seen on a camera that leads here first of all. (ST-03)"""
        for (src, dst), priority in self.edges.items():
            if dst == camera and priority == "P0":
                near = [g for g, p in self.people.items() if not p.staff and p.camera == src and at - p.at <= self.reach(src, camera)]
                if len(near) == 1:
                    return near[0]
        return None

    def resolve(self, camera: str, track: int, at: float, x: float, y: float, emb: np.ndarray | None, staff: bool = False) -> tuple[str, str, float]:
        """(id, how it was found, score)."""
        self.people = {k: p for k, p in self.people.items() if at - p.at <= TTL_S}
        gid, how, score = None if staff else self.recovered(camera, at, x, y, emb), "recovered", 1.0
        if gid is None:
            (gid, score), how = self.matched(camera, at, emb, staff), "matched"
        if gid is None and not staff:
            gid, how, score = self.alone(camera, at), "solo", 0.85
        if gid is None:
            gid = str(uuid.uuid5(_SPACE, f"{camera}:{track}:{at:.3f}"))
            self.people[gid] = Person(at, camera, emb, staff)
            return gid, "new", 1.0
        p = self.people[gid]
        p.at, p.camera = at, camera
        if emb is not None:
            mixed = emb if p.emb is None else (1 - BLEND) * p.emb + BLEND * emb
            p.emb = mixed if p.emb is None else mixed / (np.linalg.norm(mixed) or 1.0)
        return gid, how, score


IDENTITIES = "store_id string, camera_id string, local_track_id int, run long, global_id string, how string, score double"


def resolve_identities(runs: DataFrame, edges: dict[tuple[str, str], str], roles: dict[str, str] | None = None) -> DataFrame:
    """Global id of each of segments(), which may have staff_at, when behaviour told that it is staff. (ST-01..ST-03, ST-09, ST-13)

    Each decision depends on those before it in the store, as far as somebody is remembered.
    People are forgotten after TTL_S, so where nothing begins or ends for longer a store is cut
    (in time ranges, so that no task sees a store), and the pieces are decided side by side. A
    row is a begin, an end or a sign of a segment, not a frame.

    From the sign on a person is staff: no visitor is matched with them, they are not the one
    visitor at hand, and their lost track is not looked for.
    """
    roles = roles or {}
    runs = runs if "staff_at" in runs.columns else runs.withColumn("staff_at", F.lit(None).cast("timestamp"))
    keys = ["store_id", "camera_id", "local_track_id", "run"]
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    what = lambda order, at, x, y, emb: F.struct(F.lit(order).alias("order"), sec(at).alias("at"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(emb).alias("emb"))
    told = F.array(what(0, "left", "x1", "y1", "emb1"), what(1, "began", "x0", "y0", "emb0"), what(2, "staff_at", "x0", "y0", "emb0"))
    events = runs.select(*keys, (F.col("began") != F.col("left")).alias("lasts"), F.col("staff_at").isNotNull().alias("signed"), F.explode(told).alias("e")).select(*keys, "lasts", "signed", "e.*").where("at is not null")
    parts = chains(events, ["store_id"], "at", ["order", "camera_id", "local_track_id", "run"], TTL_S)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known, out, names = Identities(edges, roles), [], {}
        # At one time ends come first, then begins, then signs; a segment of one frame never gets lost.
        for e in sorted(pdf.itertuples(index=False), key=lambda e: (e.at, bool(e.lasts) if e.order == 0 else True, e.order, e.camera_id, e.local_track_id, e.run)):
            name = (e.camera_id, e.local_track_id, e.run)
            emb = None if e.emb is None else np.asarray(e.emb, float)
            if e.order == 1:
                gid, how, score = known.resolve(e.camera_id, int(e.local_track_id), e.at, e.x, e.y, emb, roles.get(e.camera_id) == "backroom")
                names[name] = gid
                out.append((key[0], e.camera_id, int(e.local_track_id), int(e.run), gid, how, score))
                continue
            person = known.people.get(names.get(name))
            if person is None or e.at - person.at > TTL_S:
                continue
            if e.order == 2:
                person.staff = True
            elif roles.get(e.camera_id) != "backroom" and not person.staff and not e.signed:
                known.lost.append((e.at, names[name], e.camera_id, e.x, e.y, emb))
        return pd.DataFrame(out, columns=["store_id", "camera_id", "local_track_id", "run", "global_id", "how", "score"])

    return parts.groupBy("store_id", "chain").applyInPandas(run, IDENTITIES)


# ------------------------------------------------------------ persons: overlap and sessions
PERSON = (
    "store_id string, global_id string, camera_id string, local_track_id int, ts timestamp, zone_id string, zone_type string, kind string, direction string, dwell_ms long, "
    "is_staff boolean, suppressed boolean, session_no int, is_reentry boolean, is_store_exit boolean, session_started timestamp, foot_x double, foot_y double"
)


def person_events(moves: DataFrame, rules: list[dict] | None = None, roles: dict[str, str] | None = None, cooldown_s: float = GAP_S) -> DataFrame:
    """moves (store_id, global_id, camera_id, local_track_id, ts, zone_id, zone_type, kind, direction, dwell_ms, is_staff), with sessions, and enters that another camera tells already. (ST-04, ST-08, ST-12)

    rules: {suppress_camera, suppress_zone_types, active_camera, active_zone_types, within_seconds}.
    kind: enter, exit, recovered (a track of somebody known begins) or staff (a sign). A session
    begins, resumes and ends as visit_step() says; the event that ends one still belongs to it.
    """
    know = Rules(rules, roles, cooldown_s)
    for c in ("foot_x", "foot_y"):
        moves = moves if c in moves.columns else moves.withColumn(c, F.lit(None).cast("double"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, state = [], nobody()
        clean = pdf.astype(object).where(pdf.notna(), None)
        for r in clean.sort_values(["ts", "camera_id", "zone_id"], kind="stable", na_position="first").itertuples():
            staff = bool(r.is_staff)
            _, told = visit_step(state, know, r.ts.value // 1000, r.camera_id, r.zone_type, r.kind, r.direction, staff)
            began = None if told["began"] is None else pd.Timestamp(told["began"], unit="us")
            out.append((*key, r.camera_id, r.local_track_id, r.ts, r.zone_id, r.zone_type, r.kind, r.direction, r.dwell_ms, staff, told["hidden"], told["session"], told["again"], told["out"], began, r.foot_x, r.foot_y))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in PERSON.split(", ")])
        return frame.astype({"dwell_ms": "Int64", "session_no": "Int32"})

    return moves.groupBy("store_id", "global_id").applyInPandas(run, PERSON)


def session_rows(persons: DataFrame) -> DataFrame:
    """Sessions of person_events(): start, end if the last event ended it, re-entry, staff. (ST-04, K-06's input)"""
    s = persons.where("session_no is not null")
    closes = F.coalesce(F.col("is_store_exit") | (F.col("is_staff") & (F.coalesce("zone_type", F.lit("")) != "staff_only")), F.lit(False))
    return s.groupBy("store_id", F.col("global_id").alias("external_track_id"), "session_no").agg(
        F.min("session_started").alias("started_at"), F.max("ts").alias("last_at"), F.max_by(F.when(closes, F.col("ts")), F.struct("ts", closes)).alias("ended_at"), F.bool_or("is_reentry").alias("is_reentry"), F.bool_or(F.col("is_staff") & closes).alias("staff")
    )


def envelopes(persons: DataFrame, tenant_id: str, correlation_id: str, detector_mode: str = "yolo", names: dict[str, str] | None = None) -> DataFrame:
    """Zone events to ingest of person_events(). (ST-15)"""
    return zone_events(persons, tenant_id, correlation_id, detector_mode, names)


def store_moves(frames: DataFrame, zones: dict[str, list[dict]], edges: dict[tuple[str, str], str], roles: dict[str, str], step: int = 1) -> DataFrame:
    """Frame tracks to moves of persons, staff signs and tracks found again, stage by stage. (ST-11)

    Moves and staff signs are told by the segment alone, so they come first, and identities know
    who is staff from when. A segment of somebody known takes up a session ended just before.
    """
    from .jobs import zone_moves

    runs = segments(frames, step)
    keys = ["store_id", "camera_id", "local_track_id"]
    # Each local track has few runs; a frame belongs to the one around it.
    spans = runs.select(*keys, "run", "first_frame", "last_frame")
    named = frames.join(spans, keys).where("frame_index between first_frame and last_frame").select(*(frames[c] for c in frames.columns), "run")
    moves = settled(zone_moves(named, zones, roles, signs=True))
    signs = moves.where("kind = 'staff'").groupBy(*keys, "run").agg(F.min("ts").alias("staff_at"))
    runs = runs.join(signs, [*keys, "run"], "left")
    who = settled(resolve_identities(runs, edges, roles))
    known = who.where("how <> 'new'").join(runs.select(*keys, "run", F.col("began").alias("ts")), [*keys, "run"])
    none = {"zone_id": "string", "zone_type": "string", "direction": "string", "dwell_ms": "long", "foot_x": "double", "foot_y": "double"}
    begins = known.select(*keys, "global_id", "ts", F.lit("recovered").alias("kind"), F.lit(False).alias("is_staff"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    told = moves.join(who.select(*keys, "run", "global_id"), [*keys, "run"])
    return told.select(*begins.columns).unionByName(begins)


def track_store(frames: DataFrame, zones: dict[str, list[dict]], edges: dict[tuple[str, str], str], roles: dict[str, str], rules: list[dict] | None = None, step: int = 1, cooldown_s: float = GAP_S) -> DataFrame:
    """Enters and exits of persons with their sessions, from frame tracks. (ST-11)"""
    return person_events(store_moves(frames, zones, edges, roles, step), rules, roles, cooldown_s).where(F.col("kind").isin("enter", "exit"))


def store_sessions(frames: DataFrame, zones: dict[str, list[dict]], edges: dict[tuple[str, str], str], roles: dict[str, str], rules: list[dict] | None = None, step: int = 1, cooldown_s: float = GAP_S) -> DataFrame:
    """Sessions of persons, from frame tracks; signs of staff end them even where nothing moves. (ST-04, ST-11)"""
    return sessions_by_doors(store_moves(frames, zones, edges, roles, step), Rules(rules, roles, cooldown_s))
