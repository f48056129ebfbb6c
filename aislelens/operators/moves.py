"""Zone enters, exits and line crossings as islands of a track and one fold over the few frames that can change its state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..streaming import jobs
from .ordered import settled

TRACK = ["store_id", "camera_id", "local_track_id", "run"]
#: No time: before all others, and still safe to subtract.
NEVER = -(10**15)


def _inside(points: list[list[float]]) -> str:
    """The even-odd rule for a known polygon, written out edge by edge: columns.in_polygon() without arrays."""
    known = [[float(v) for v in p] for p in points]
    edges = (
        f"cast(({ay!r}D > foot_y) <> ({by!r}D > foot_y) and foot_x < {bx - ax!r}D * (foot_y - {ay!r}D) / {by - ay + 1e-9!r}D + {ax!r}D as int)"
        for (ax, ay), (bx, by) in zip(known, [known[-1], *known[:-1]], strict=True)
    )
    return f"(({' + '.join(edges)}) % 2 = 1)" if len(points) >= 3 else "false"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_camera(parts: dict[str, str], default: str) -> str:
    """The expression of the row's camera."""
    return f"case camera_id {' '.join(f'when {_text(cam)} then {x}' for cam, x in parts.items())} else {default} end" if parts else default


def numbered_zones(zones: dict[str, list[dict]]) -> dict[str, list[dict]]:
    """Zones that give moves, by camera, with their place and the place of their type."""
    out = {}
    for cam, zs in zones.items():
        use = [z for z in zs if not z.get("exclude_detections") and not (z.get("kind") == "line" and z.get("counting_only"))]
        types = sorted({z["zone_type"] for z in use} | {t for z in use for k in ("require_prior_zone_types", "dedupe_after_zone_types") for t in z.get(k) or ()})
        out[cam] = [dict(z, place=k, type_place=types.index(z["zone_type"]), types=types) for k, z in enumerate(use)]
    return out


SIGHT = "place int, line boolean, inside boolean, core boolean, sign int, way double"


def _sights(zs: list[dict]) -> str:
    """What a frame sees of each zone of its camera: inside, well inside; for lines the side, and the way across since the frame before."""
    out = []
    for z in zs:
        if z.get("kind", "polygon") == "line":
            (a, b), normal = (tuple(map(float, p)) for p in z["points"][:2]), z.get("direction_normal")
            unit = C.line_normal(a, b, tuple(normal) if normal else None)
            nx, ny = map(float, normal or unit)
            side = f"((foot_x - {a[0]!r}D) * {nx!r}D + (foot_y - {a[1]!r}D) * {ny!r}D)"
            sign = f"case when {side} > {jobs.LINE_SLACK!r}D then 1 when {side} < -{jobs.LINE_SLACK!r}D then -1 else 0 end"
            seen = ("true", "null", "null", sign, f"abs((foot_x - last_x) * {float(unit[0])!r}D + (foot_y - last_y) * {float(unit[1])!r}D)")
        else:
            seen = ("false", _inside(z["points"]), _inside(jobs.shrunk(z["points"], jobs.POLYGON_SLACK)), "null", "null")
        fields = ", ".join(f"{n!r}, cast({v} as {t})" for v, (n, t) in zip(seen, (x.split() for x in SIGHT.split(", ")[1:]), strict=True))
        out.append(f"named_struct('place', {z['place']}, {fields})")
    return f"array({', '.join(out)})"


def changes_of_sight(frames: DataFrame, zones: dict[str, list[dict]]) -> DataFrame:
    """(store_id, camera_id, local_track_id, run, frame_no, at, place, line, inside, core, sign, way): the frames of a track that can change what is known of a zone, `at` in ms.

    Islands are frames in a row with equal membership. Of a polygon's island those count within
    the least dwell of its begin and the one after them, as an exit may wait for that long, and
    all where one frame goes in and the next one out (inside, not well inside) or where an
    enter waits for another zone's. Of a line's the first one on a side and the first one after
    a way long enough. All other frames leave the state as it is.
    """
    use = {cam: zs for cam, zs in numbered_zones(zones).items() if zs}
    masks = {cam: [z["points"] for z in zs if z.get("exclude_detections")] for cam, zs in zones.items()}
    if "run" not in frames.columns:
        frames = frames.withColumn("run", F.lit(0).cast("long"))
    hidden = _by_camera({cam: " or ".join(map(_inside, ms)) for cam, ms in masks.items() if ms}, "false")
    nothing = f"cast(array() as array<struct<{', '.join(x.replace(' ', ': ') for x in SIGHT.split(', '))}>>)"
    places = {cam: [str(z["place"]) for z in zs if z.get("require_prior_zone_types")] for cam, zs in use.items()}
    waits = _by_camera({cam: f"place in ({', '.join(ks)})" for cam, ks in places.items() if ks}, "false")
    track, zone = ", ".join(TRACK), ", ".join([*TRACK, "place"])
    w = f"over (partition by {track} order by ts, foot_x, foot_y)"
    f = frames.where(f"not ({hidden})").selectExpr(*TRACK, "unix_millis(cast(ts as timestamp)) as at", "foot_x", "foot_y", f"lag(foot_x) {w} as last_x", f"lag(foot_y) {w} as last_y", f"row_number() {w} as frame_no")
    sights = _by_camera({cam: _sights(zs) for cam, zs in use.items()}, nothing)
    seen = f.selectExpr(*TRACK, "at", "frame_no", f"explode({sights}) as x").selectExpr(*TRACK, "at", "frame_no", "x.*").where("not line or sign <> 0")
    what = "struct(inside, core, sign)"
    seen = seen.selectExpr("*", f"case when lag({what}) over (partition by {zone} order by frame_no) <=> {what} then 0 else 1 end as begins")
    seen = seen.selectExpr("*", f"sum(begins) over (partition by {zone} order by frame_no rows unbounded preceding) as island")
    i, wide = f"over (partition by {zone}, island order by frame_no rows unbounded preceding)", f"coalesce(way >= {jobs.LEAST_WAY!r}D, false)"
    kept = seen.selectExpr("*", f"coalesce(lag(at) over (partition by {zone}, island order by frame_no) - first(at) {i} < {jobs.LEAST_DWELL_MS}, true) as soon", f"{wide} as wide", f"count_if({wide}) {i} as wides")
    kept = kept.where(f"case when line then begins = 1 or (wide and wides = 1) else soon or (inside and not core) or (inside and {waits}) end")
    return kept.select(*TRACK, "frame_no", "at", "place", "line", "inside", "core", "sign", "way")


MOVE = "at: bigint, place: int, kind: string, direction: string, dwell_ms: bigint"


def _fold(zs: list[dict]) -> str:
    """aggregate() over the sights of a track of one camera: its moves in order."""

    def by_zone(of: Callable[[dict], str | None], default: str) -> str:
        parts = [f"when {z['place']} then {x}" for z in zs if (x := of(z)) is not None]
        return f"case x.place {' '.join(parts)} else {default} end" if parts else default

    def one_of(test: str, names: str) -> Callable[[dict], str | None]:
        """Whether `test` holds for the last enter of one of a zone's listed types."""
        return lambda z: "(" + " or ".join(test.format(at=f"s.entered[{z['types'].index(t)}]", wait=int(1000 * z.get("dedupe_after_seconds", jobs.AFTER_S))) for t in z[names]) + ")" if z.get(names) else None

    def put(xs: str, place: str, value: str) -> str:
        return f"transform(s.{xs}, (v, k) -> case when k = {place} then {value} else v end)"

    type_place = by_zone(lambda z: str(z["type_place"]), "0")
    again = f"(x.at - s.entered[{type_place}] <= {int(1000 * jobs.SAME_TYPE_S)})"
    # Polygons: out beyond the core after the least dwell; in at the edge, told unless a like enter was just told.
    since = "s.since[x.place]"
    goes = f"(not x.line and {since} <> {NEVER} and not x.core and x.at - {since} >= {jobs.LEAST_DWELL_MS})"
    ready = by_zone(one_of(f"{{at}} <> {NEVER}", "require_prior_zone_types"), "true")
    after = by_zone(one_of("x.at - {at} <= {wait}", "dedupe_after_zone_types"), "false")
    comes = f"(not x.line and {since} = {NEVER} and x.inside and {ready})"
    told = f"({comes} and not {after} and not {again})"
    # Lines: another side, not just crossed, with a way across.
    turned, soon = "(s.side[x.place] * x.sign < 0)", f"(s.cross[x.place] <> {NEVER} and x.at - s.cross[x.place] < {int(1000 * jobs.LINE_S)})"
    over = f"(x.line and {turned} and not {soon} and coalesce(x.way >= {jobs.LEAST_WAY!r}D, true))"
    inward = "(x.sign > s.side[x.place])"
    counted = f"({over} and not ({inward} and {again}))"
    kind, way, dwell = f"case when {goes} then 'exit' else 'enter' end", f"case when x.line then case when {inward} then 'in' else 'out' end end", f"case when {goes} then x.at - {since} end"
    step = f"""named_struct(
        'since', case when {goes} then {put('since', 'x.place', f'{NEVER}L')} when {comes} then {put('since', 'x.place', 'x.at')} else s.since end,
        'side', case when x.line and (not {turned} or {soon} or {over}) then {put('side', 'x.place', 'x.sign')} else s.side end,
        'cross', case when {over} then {put('cross', 'x.place', 'x.at')} else s.cross end,
        'entered', case when {told} or {counted} then {put('entered', type_place, 'x.at')} else s.entered end,
        'moves', case when {told} or {counted} or {goes} then array_append(s.moves, named_struct('at', x.at, 'place', x.place, 'kind', {kind}, 'direction', {way}, 'dwell_ms', {dwell})) else s.moves end)"""
    never = lambda n: f"array_repeat({NEVER}L, {n})"
    start = f"named_struct('since', {never(len(zs))}, 'side', array_repeat(0, {len(zs)}), 'cross', {never(len(zs))}, 'entered', {never(len(zs[0]['types']))}, 'moves', cast(array() as array<struct<{MOVE}>>))"
    return f"aggregate(sights, {start}, (s, x) -> {step}, s -> s.moves)"


def zone_moves(frames: DataFrame, zones: dict[str, list[dict]]) -> DataFrame:
    """Enters, exits and crossings (store_id, camera_id, local_track_id, run, ts, zone_id, zone_type, kind, direction, dwell_ms) of frame tracks. (ST-05..ST-07, W-06)

    The same moves as jobs.zone_moves() gives, without Python: windows compress a track to the
    frames that can change its state, and aggregate() folds these in order. Frames inside zones
    marked exclude_detections are left out; of a camera without zones nothing is told. A track's
    changes meet in one row, frames don't.
    """
    use = {cam: zs for cam, zs in numbered_zones(zones).items() if zs}
    sights = F.array_sort(F.collect_list(F.struct("frame_no", "place", "at", "line", "inside", "core", "sign", "way")))
    tracks = settled(changes_of_sight(frames, zones).groupBy(*TRACK).agg(sights.alias("sights")))  # read once a camera
    if not use:
        raise ValueError("no camera has zones")
    out = None
    for cam, zs in use.items():
        known = ", ".join(f"named_struct('zone_id', {_text(z['zone_id'])}, 'zone_type', {_text(z['zone_type'])})" for z in zs)
        got = tracks.where(F.col("camera_id") == cam).selectExpr(*TRACK, f"explode({_fold(zs)}) as m").selectExpr(*TRACK, "m", f"array({known})[m.place] as z")
        got = got.selectExpr(*TRACK, "timestamp_millis(m.at) as ts", "z.zone_id", "z.zone_type", "m.kind", "m.direction", "m.dwell_ms")
        out = got if out is None else out.unionByName(got)
    return out


def debounced(moves: DataFrame, same_type_s: float = jobs.SAME_TYPE_S, line_s: float = jobs.LINE_S) -> DataFrame:
    """moves with a global_id, less those enters and crossings that the same person's last told one of the zone is too near to, over all cameras. (ST-07)

    An enter (no direction) waits for `same_type_s` after the zone's last told enter, a crossing
    (in or out) for `line_s` after its last told crossing. A told one starts the wait, a
    swallowed one doesn't, so a person's moves of a zone are folded in order; most have one.
    Exits and moves of nobody are kept.
    """
    judged = moves.where("kind = 'enter' and global_id is not null").withColumn("us_", F.unix_micros("ts"))
    key = ["store_id", "global_id", "zone_id"]
    folded = judged.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("us_", F.struct(*moves.columns).alias("row_")))).alias("x"))
    start = F.struct(F.lit(NEVER).cast("long").alias("enter"), F.lit(NEVER).cast("long").alias("cross"), F.array().cast(folded.select("x").schema["x"].dataType).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        line = x["row_"]["direction"].isNotNull()
        ok = x["us_"] - F.when(line, s["cross"]).otherwise(s["enter"]) > F.when(line, int(line_s * 1e6)).otherwise(int(same_type_s * 1e6))
        return F.struct(F.when(ok & ~line, x["us_"]).otherwise(s["enter"]).alias("enter"), F.when(ok & line, x["us_"]).otherwise(s["cross"]).alias("cross"), F.when(ok, F.array_append(s["kept"], x)).otherwise(s["kept"]).alias("kept"))

    kept = folded.select(F.explode(F.aggregate("x", start, step, lambda s: s["kept"])).alias("k")).select("k.row_.*")
    return kept.unionByName(moves.where("kind <> 'enter' or global_id is null"))
