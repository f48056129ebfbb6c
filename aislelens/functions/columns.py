"""Scalar functions as Column expressions; none needs Python on an executor."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone types, funnel stages and event vocabulary.
QUEUE_ZONES = ("checkout", "billing_queue", "queue", "billing")
ENTRY_ZONES = ("entry_threshold", "entrance", "entry")
BROWSE_ZONES = ("browse", "browse_skincare", "browse_cosmetics", "aisle", "display", "zone", "promo_island", "consultation")
HIDDEN_ZONES = ("staff_only", "ignore")
ENTERED, EXITED, PURCHASE, FRAME, ENDED = "vision.zone.entered", "vision.zone.exited", "analytics.purchase.completed", "vision.frame.processed", "vision.track.ended"
STAGES = ("ENTRY", "ZONE_VISIT", "BILLING_QUEUE", "PURCHASE")
STAGE_LABELS = {"ENTRY": "Visitor", "ZONE_VISIT": "Zone Visit", "BILLING_QUEUE": "Billing Queue", "PURCHASE": "Purchase"}
#: Stage of each zone type.
ZONE_STAGES = dict.fromkeys(ENTRY_ZONES, "ENTRY") | dict.fromkeys(BROWSE_ZONES, "ZONE_VISIT") | dict.fromkeys(QUEUE_ZONES, "BILLING_QUEUE")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_customer_event() -> Column:
    """Not staff, not in a hidden zone; nulls pass. (P-01)"""
    return (F.lower(F.coalesce("class_label", F.lit(""))) != "staff") & ~F.lower(F.coalesce("zone_type", F.lit(""))).isin(*HIDDEN_ZONES)


def is_customer_track() -> Column:
    """(P-03)"""
    t = F.coalesce("external_track_id", F.lit(""))
    return is_customer_event() & (t != "") & (F.lower(t) != "null")


def json_flag(payload: Column | str, key: str) -> Column:
    """JSON true, "true", "True" or "1". (P-05)"""
    return F.lower(F.coalesce(F.get_json_object(c(payload), f"$.{key}"), F.lit(""))).isin("true", "1")


def in_period(ts: str, start: str, end: str) -> Column:
    """Both ends belong to the period; on the raw column, so that scans prune. (P-04)"""
    return F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def is_queue() -> Column:
    """(P-14)"""
    z = F.coalesce("zone_id", F.lit(""))
    return F.coalesce(F.col("zone_type").isin(*QUEUE_ZONES), F.lit(False)) | z.contains("queue") | z.contains("billing") | z.contains("checkout")


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a small fixed map, null where there is none."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def zone_stages(custom: dict[str, str] | None = None) -> dict[str, str]:
    """ZONE_STAGES with a store's own entries over it; values that name no stage are left out. (P-08)"""
    return ZONE_STAGES | {k.lower(): v.upper() for k, v in (custom or {}).items() if v.upper() in STAGES}


def stage(explicit: Column | None = None, custom: dict[str, str] | None = None) -> Column:
    """Funnel stage of an event: the one it names (a wrong name gives none), else its zone type's; PURCHASE for purchases without either. (P-07, P-08)"""
    by_zone = lookup(zone_stages(custom), F.lower("zone_type"))
    if explicit is not None:
        named = F.upper(F.nullif(explicit, F.lit("")))
        by_zone = F.when(named.isNotNull(), F.when(named.isin(*STAGES), named)).otherwise(by_zone)
    return F.coalesce(by_zone, F.when(F.col("event_type") == PURCHASE, F.lit("PURCHASE")))


def stage_label(x: Column | str) -> Column:
    """(P-23)"""
    return F.coalesce(lookup(STAGE_LABELS, c(x)), c(x))


def emitted(zone_type: Column | str, is_staff: Column | str) -> Column:
    """Whether a zone event leaves the pipeline: none from ignored zones, of staff only from staff zones. (P-21)"""
    z = F.lower(F.coalesce(c(zone_type), F.lit("")))
    return (z != "ignore") & (~F.coalesce(c(is_staff), F.lit(False)) | (z == "staff_only"))


def store_entry(direction: Column | str, zone_type: Column | str) -> Column:
    """(P-22)"""
    return F.coalesce((c(direction) == "in") & c(zone_type).isin("entry_threshold", "entrance"), F.lit(False))


def dwell_seconds() -> Column:
    """dwell_ms in seconds where there is one, else dwell_seconds. (P-11)"""
    return F.coalesce(F.col("dwell_ms") / 1000.0, F.col("dwell_seconds"))


def zone_key() -> Column:
    """(P-10)"""
    z, t = F.nullif("zone_id", F.lit("")), F.nullif("zone_type", F.lit(""))
    return F.when(z.isNotNull(), F.concat(F.lit("id:"), z)).when(t.isNotNull(), F.concat(F.lit("type:"), F.lower(t)))


def hour(ts: str) -> Column:
    """(F-08, ST-17)"""
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def video_name(x: Column | str) -> Column:
    """(P-17)"""
    return F.trim(F.substring_index(F.regexp_replace(F.regexp_replace(c(x), '^"|"$', ""), r"\\", "/"), "/", -1))


def severity(x: Column | str) -> Column:
    """critical, warning or warn, info in any case; anything else in upper case. (P-18)"""
    u = F.upper(c(x))
    return F.when(u == "WARNING", "WARN").otherwise(u)


def detection_ok(min_h: float, min_area: float, max_area: float, min_conf: float) -> Column:
    """(P-19)"""
    w, h = F.col("bbox.w"), F.col("bbox.h")
    return (h >= min_h) & (w * h).between(min_area, max_area) & (h / w).between(1.2, 5.5) & (F.col("confidence") >= min_conf)


def top_left(cx: str, cy: str, w: str, h: str, width: int, height: int) -> Column:
    """Centre box in pixels -> top-left box in 0..1. (P-20)"""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.struct(
        clamp((c(cx) - c(w) / 2) / width).alias("x"), clamp((c(cy) - c(h) / 2) / height).alias("y"), clamp(c(w) / width).alias("w"), clamp(c(h) / height).alias("h")
    )


def foot_point(bbox: str) -> Column:
    """(F-01)"""
    b = F.col(bbox)
    return F.struct((b["x"] + b["w"] / 2).alias("x"), (b["y"] + b["h"]).alias("y"))


def in_polygon(x: Column | str, y: Column | str, points: Column | str) -> Column:
    """Even-odd rule over the polygon's edges. (F-02)"""
    x, y, p = c(x), c(y), c(points)
    n = F.size(p)

    def crosses(i: Column) -> Column:
        a, b = F.get(p, i), F.get(p, (i + n - 1) % n)
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"] + 1e-9) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.when(n >= 3, F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1).otherwise(F.lit(False))


def line_normal(a: tuple[float, float], b: tuple[float, float], normal: tuple[float, float] | None = None) -> tuple[float, float]:
    """The given normal, or the line's own, at length 1. (F-03)"""
    x, y = normal or (-(b[1] - a[1]), b[0] - a[0])
    n = math.hypot(x, y) or 1.0
    return x / n, y / n


def line_side(x: Column | str, y: Column | str, a: tuple[float, float], b: tuple[float, float], normal: tuple[float, float] | None = None) -> Column:
    """Distance from the line a-b with its sign: along a given normal as it is (not scaled), else along the line's own at length 1. (F-03)"""
    nx, ny = normal or line_normal(a, b)
    return (c(x) - a[0]) * F.lit(float(nx)) + (c(y) - a[1]) * F.lit(float(ny))


def side_sign(side: Column, slack: float) -> Column:
    """1, -1, or 0 inside the slack. (F-04)"""
    return F.when(side > slack, 1).when(side < -slack, -1).otherwise(0)


def scaled_polygon(points: Column | str, factor: float) -> Column:
    """Polygon scaled about the mean of its vertices. (F-05)"""
    p = c(points)
    n = F.size(p)
    mean = lambda k: F.aggregate(p, F.lit(0.0), lambda s, q: s + q[k]) / n
    return F.transform(p, lambda q: F.struct((mean("x") + (q["x"] - mean("x")) * factor).alias("x"), (mean("y") + (q["y"] - mean("y")) * factor).alias("y")))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """A zero denominator counts as 1. (F-06)"""
    d = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(d == 0, 1.0).otherwise(d)


def blended(old: str, new: str, alpha: float) -> Column:
    """Moving average of embeddings, length 1 again. (F-07)"""
    mixed = F.zip_with(old, new, lambda x, y: x * (1 - alpha) + y * alpha)
    n = F.sqrt(dot(mixed, mixed))
    return F.transform(mixed, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (RFC 4122, version 5). (F-13, R-07)"""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), F.encode(name, "UTF-8")))
    v = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(v, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def pos_time(day: str, time: str) -> Column:
    """(F-09)"""
    return F.try_to_timestamp(F.concat_ws(" ", day, time), F.lit("dd-MM-yyyy HH:mm:ss"))


def money(x: str) -> Column:
    """Blank or unreadable: 0. (F-10)"""
    return F.coalesce(F.expr(f"try_cast(nullif(trim({x}), '') as decimal(18,4))"), F.lit(0).cast("decimal(18,4)"))


def clock(x: Column | str) -> Column:
    """A time stamp without a zone counts as UTC. (F-12)"""
    return c(x).cast("timestamp_ntz")


def iso_utc(x: Column | str) -> Column:
    """2024-01-31T10:00:00Z, with a fraction where there is one. (F-21)"""
    t = clock(x)
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.date_format(t, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(t, "SSSSSS"))).otherwise(""), F.lit("Z"))


def from_iso(x: Column | str) -> Column:
    """What iso_utc() writes, and offsets; unreadable: null. (F-21)"""
    return F.try_to_timestamp(F.regexp_replace(c(x), "Z$", "+00:00")).cast("timestamp_ntz")


def has_key(payload: Column | str, key: str) -> Column:
    """Whether a JSON object has a key, be its value null. (F-15)"""
    return F.coalesce(F.array_contains(F.json_object_keys(c(payload)), key), F.lit(False))


def json_items(payload: Column | str, key: str) -> Column:
    """Length of the JSON array under a key; no array: 0. (F-15)"""
    return F.coalesce(F.json_array_length(F.get_json_object(c(payload), f"$.{key}")), F.lit(0))


def json_int(payload: Column | str, key: str) -> Column:
    """A JSON number or text as an int; unreadable: null. (F-16)"""
    return F.get_json_object(c(payload), f"$.{key}").try_cast("int")


def percent(x: Column | str, digits: int = 1) -> Column:
    """0.123 -> 12.3%. (F-20, R-09)"""
    return F.format_string(f"%.{digits}f%%", c(x).cast("double") * 100)


def money_text(x: Column | str, sign: str = "") -> Column:
    """1234.5 -> 1,234.50. (F-20)"""
    return F.concat(F.lit(sign), F.format_number(c(x).cast("double"), 2))


# Weights of an identity match, and what its camera part is on an edge, on the same camera, elsewhere.
MATCH_WEIGHTS = {"cosine": 0.55, "time_gap": 0.20, "camera_graph": 0.15, "apparel": 0.10}
ON_EDGE, SAME_CAMERA, OFF_EDGE = 1.0, 0.45, 0.3
#: Longest handoff in seconds by its kind.
HANDOFF_S = {"entry_to_floor": 150.0, "floor_to_billing": 210.0, "billing_to_backroom": 300.0, "floor_to_floor": 270.0}


def match_score(cosine_: Column | str, gap_s: Column | str, max_gap_s: Column | str, graph: Column | str, apparel: Column | str) -> Column:
    """Weighted identity score of a handoff: likeness, time left, camera graph, apparel. (F-24)"""
    w = MATCH_WEIGHTS
    fresh = F.greatest(F.lit(0.0), 1 - c(gap_s) / F.greatest(c(max_gap_s), F.lit(1.0)))
    return w["cosine"] * F.greatest(F.lit(0.0), c(cosine_)) + w["time_gap"] * fresh + w["camera_graph"] * c(graph) + w["apparel"] * c(apparel)


def max_handoff(priority: Column | str, from_role: Column | str, to_role: Column | str) -> Column:
    """Longest handoff of an edge in seconds; no edge: floor to floor. (F-25)"""
    h = HANDOFF_S
    first = F.when(c(from_role) == "entry", h["entry_to_floor"]).when(c(to_role) == "billing", h["floor_to_billing"]).otherwise(h["entry_to_floor"])
    return F.when(c(priority) == "P0", first).when(c(priority) == "P1", h["billing_to_backroom"]).otherwise(h["floor_to_floor"])


def handoff_reason(score: Column | str, threshold: float = 0.68) -> Column:
    """How a handoff is explained, and with what score: by likeness, or as the only visitor at hand. (F-23)"""
    s = c(score)
    alike = s >= threshold
    return F.struct(
        F.when(alike, "appearance+camera_graph+time").otherwise("p0_solo_handoff").alias("method"),
        F.round(F.least(F.lit(1.0), F.when(alike, s).otherwise(F.greatest(s, F.lit(0.85)))), 3).alias("match_score"),
    )


def minutes_between(later: str, earlier: str) -> Column:
    """(F-22)"""
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    return (us(later) - us(earlier)) / 6e7
