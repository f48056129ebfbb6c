"""Sessions, funnel and journeys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


TRACK_EVENTS = (C.ENTERED, C.EXITED, "vision.track.started", C.ENDED)


def materialize_sessions(events: DataFrame, keep_staff: bool = False) -> DataFrame:
    """One session a track of a store: first and last event, whether it ended, whether it came in by the door. (A-36)

    A track is staff if one of its events says so or lies in a hidden zone; staff tracks are
    left out unless keep_staff. The end is that of track.ended, its own last_seen if there is
    such a column, else the last event. Pre-aggregated by track; no window, no order.
    """
    kind, track = F.col("event_type"), _track()
    hidden = F.lower(F.coalesce("zone_type", F.lit(""))).isin(*C.HIDDEN_ZONES)
    staff = (F.lower(F.coalesce("class_label", F.lit(""))) == "staff") | hidden
    flag = F.coalesce(F.col("is_store_entry"), F.lit(False)) if "is_store_entry" in events.columns else F.lit(False)
    came = (kind == C.ENTERED) & (flag | F.lower(F.coalesce("zone_type", F.lit(""))).isin(*C.ENTRY_ZONES) | ~staff)
    ended = F.coalesce(F.col("last_seen"), F.col("occurred_at")) if "last_seen" in events.columns else F.col("occurred_at")
    got = (
        events.where(kind.isin(*TRACK_EVENTS)).withColumn("external_track_id", track).where("external_track_id is not null")
        .groupBy("store_id", "external_track_id")
        .agg(
            F.min("occurred_at").alias("started_at"), F.max_by(F.when(kind == C.ENDED, ended), F.when(kind == C.ENDED, F.col("occurred_at"))).alias("finished_at"),
            F.max("occurred_at").alias("last_at"), F.count("*").alias("n_events"), F.bool_or(staff).alias("staff"), F.bool_or(came).alias("store_entry"),
        )
    )
    got = got if keep_staff else got.where("not staff")
    return got.select(
        "store_id", "external_track_id", "started_at", F.coalesce("finished_at", "last_at").alias("ended_at"),
        F.when(F.col("finished_at").isNotNull(), "completed").otherwise("active").alias("status"), "n_events", "staff", "store_entry",
    )


def visit_gaps(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Visits of a track: a gap of more than `gap_minutes` between vision events begins a new one. (W-05, ST-04 in batch)

    Keyed by store and track, so a store's size doesn't matter; one track's events are one window.
    """
    w = Window.partitionBy("store_id", "external_track_id").orderBy("occurred_at", "event_id")
    seconds = lambda x: F.unix_micros(x.cast("timestamp")) / 1e6
    gap = seconds(F.col("occurred_at")) - seconds(F.lag("occurred_at").over(w))
    marked = events.where(F.col("event_type").startswith("vision.")).withColumn("new", F.when(gap.isNull() | (gap > 60 * gap_minutes), 1).otherwise(0))
    return (
        marked.withColumn("sess", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("external_track_id", "store_id", "sess")
        .agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"), F.count("*").alias("n_events"))
    )


def _track(col: str = "external_track_id"):
    """A track id, null if it names none."""
    t = F.col(col).cast("string")
    return F.when((t != "") & (F.lower(t) != "null"), t)


def _keyed(rows: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """rows with visitor_key and linked_track: of the linked session where there is a session_id, else of the track. (J-01, J-02)

    Rows of a staff session, of an unknown session, or without session and track go. sessions
    are all sessions (store_id, session_id, external_track_id, staff), whatever the period.
    """
    track = _track()
    if "session_id" not in rows.columns:
        return rows.withColumn("linked_track", track).withColumn("visitor_key", F.concat(F.lit("track:"), track)).where("visitor_key is not null")
    if sessions is None:
        raise ValueError("rows with a session_id need sessions")
    linked = sessions.select("store_id", "session_id", _track().alias("session_track"), F.coalesce("staff", F.lit(False)).alias("session_staff"))
    joined = rows.join(linked, ["store_id", "session_id"], "left")
    by_session = F.when(~F.col("session_staff"), F.coalesce(F.concat(F.lit("track:"), "session_track"), F.concat(F.lit("session:"), F.col("session_id").cast("string"))))
    key = F.when(F.col("session_id").isNotNull(), by_session).otherwise(F.concat(F.lit("track:"), track))
    return joined.withColumn("visitor_key", key).withColumn("linked_track", F.coalesce(track, "session_track")).where("visitor_key is not null")


def signals(events: DataFrame, tx: DataFrame, sessions: DataFrame | None = None, custom: dict[str, str] | None = None) -> DataFrame:
    """(store_id, visitor_key, stage, at): stage signals of customer events and of completed purchases, linked by session or track. (P-07..P-09, J-01, J-02, U-02)

    sessions is needed if events or tx have a session_id. A purchase event needs a track, its
    own or its session's; a zone type that names a stage, or a funnel_stage column, goes before
    PURCHASE. custom: a store's own zone types.
    """
    out = lambda df, stage: df.select("store_id", "visitor_key", stage.alias("stage"), F.col("occurred_at").alias("at"))
    bought = F.col("event_type") == C.PURCHASE
    seen = _keyed(events.where(bought | ((F.col("event_type") == C.ENTERED) & C.is_customer_event())), sessions)
    named = F.col("funnel_stage") if "funnel_stage" in events.columns else None
    vis = out(seen.where(~bought | F.col("linked_track").isNotNull()), C.stage(named, custom)).where("stage is not null")
    return vis.unionByName(out(_keyed(tx.where("status = 'completed'"), sessions), F.lit("PURCHASE")))


def visitor_stages(sig: DataFrame, sessions: DataFrame) -> DataFrame:
    """Signals of each stage by visitor; a session marks ENTRY without being a re-entry. (A-23, W-01, W-02)"""
    key = F.concat(F.lit("track:"), _track())
    if "session_id" in sessions.columns:
        key = F.coalesce(key, F.concat(F.lit("session:"), F.col("session_id").cast("string")))
    ses = sessions.where("not staff").select("store_id", key.alias("visitor_key"), F.lit(None).cast("string").alias("stage"), F.col("started_at").alias("at"))
    n = [F.count_if(F.col("stage") == s).alias(f"n_{s}") for s in C.STAGES]
    first = [F.min(F.when(F.col("stage") == s, F.col("at"))).alias(f"at_{s}") for s in C.STAGES]
    return sig.unionByName(ses).groupBy("store_id", "visitor_key").agg(*n, *first, F.count_if(F.col("stage").isNull()).alias("n_sessions"), F.min("at").alias("first_at"))


def funnel(stages: DataFrame) -> DataFrame:
    """A row for each store and stage: visitors, conversion to the next stage, drop-off, re-entries. (A-23)

    Every visitor counts in ENTRY. conversion is the share of a stage's visitors that also
    reached the next one. One aggregation of booleans by store; nothing is ordered.
    """
    has = {s: F.col(f"n_{s}") > 0 for s in C.STAGES} | {"ENTRY": F.lit(True)}
    again = {s: F.greatest(F.col(f"n_{s}") - 1, F.lit(0)) for s in C.STAGES}
    again["ENTRY"] = F.greatest(F.col("n_ENTRY") - F.when(F.col("n_sessions") > 0, 0).otherwise(1), F.lit(0))
    aggs = []
    for s, nxt in zip(C.STAGES, [*C.STAGES[1:], None], strict=True):
        both = F.count_if(has[s] & has[nxt]) if nxt else F.lit(None).cast("long")
        aggs.append(F.struct(F.lit(s).alias("stage"), F.count_if(has[s]).alias("visitors"), both.alias("both"), F.sum(again[s]).alias("reentries")).alias(s))
    wide = stages.groupBy("store_id").agg(*aggs)
    rows = wide.select("store_id", F.explode(F.array(*map(F.col, C.STAGES))).alias("x")).select("store_id", "x.*")
    share = F.col("both") / F.nullif("visitors", F.lit(0))
    conv = F.round(F.when(share > 1, 1.0).otherwise(share), 4)
    return rows.select("store_id", "stage", "visitors", conv.alias("conversion"), F.round(1 - conv, 4).alias("drop_off"), "reentries")


def conversion(stages: DataFrame) -> DataFrame:
    """(store_id, entries, purchases, rate): visitors, those that purchased, and their share. (R-02)"""
    bought = F.count_if(F.col("n_PURCHASE") > 0)
    return stages.groupBy("store_id").agg(F.count("*").alias("entries"), bought.alias("purchases"), (bought / F.count("*")).alias("rate"))


def zones_by_track(events: DataFrame) -> DataFrame:
    """(store_id, external_track_id, zones): the zone types of a track's funnel events, sorted. (J-04)"""
    e = events.where(F.col("event_type").isin(C.ENTERED, C.PURCHASE)).withColumn("external_track_id", _track()).where("external_track_id is not null and zone_type <> ''")
    return e.groupBy("store_id", "external_track_id").agg(F.array_sort(F.collect_set("zone_type")).alias("zones"))


def journeys(sig: DataFrame, events: DataFrame, tx: DataFrame) -> DataFrame:
    """Stage times of each visitor with a signal, its zones, and the last completed purchase of its track. (A-32, J-03, J-04, W-10)

    A purchase without a stage of its own gives PURCHASE its time. For a track with a purchase,
    ENTRY is at the earliest stage if there is none, and ZONE_VISIT at billing, else at the
    earliest, if the track has zones or billing. complete: entry, zone, billing and a purchase
    with a link_method or link_confidence.
    """
    first = [F.min(F.when(F.col("stage") == s, F.col("at"))).alias(f"at_{s}") for s in C.STAGES]
    v = sig.groupBy("store_id", "visitor_key").agg(*first).withColumn("external_track_id", F.when(F.col("visitor_key").startswith("track:"), F.substring("visitor_key", 7, 1 << 20)))
    link = F.coalesce(*(F.col(c).cast("string") for c in ("link_method", "link_confidence") if c in tx.columns), F.lit(None).cast("string"))
    done = tx.where("status = 'completed'").withColumn("external_track_id", _track()).where("external_track_id is not null").withColumn("link", link)
    last = done.groupBy("store_id", "external_track_id").agg(F.max(F.struct("occurred_at", "transaction_id", "amount", "link")).alias("t"))
    j = v.join(last, ["store_id", "external_track_id"], "left").join(zones_by_track(events), ["store_id", "external_track_id"], "left")
    bought, purchase = F.col("t").isNotNull(), F.coalesce("at_PURCHASE", "t.occurred_at")
    earliest = F.least("at_ENTRY", "at_ZONE_VISIT", "at_BILLING_QUEUE", purchase)
    entry = F.when(bought, F.coalesce("at_ENTRY", earliest)).otherwise(F.col("at_ENTRY"))
    moved = F.col("zones").isNotNull() | F.col("at_BILLING_QUEUE").isNotNull()
    zone = F.coalesce("at_ZONE_VISIT", F.when(bought & moved, F.coalesce("at_BILLING_QUEUE", earliest)))
    j = j.select(
        "store_id", "visitor_key", entry.alias("entry_at"), zone.alias("zone_at"), F.col("at_BILLING_QUEUE").alias("billing_at"), purchase.alias("purchase_at"),
        F.coalesce(F.array_join("zones", ","), F.lit("")).alias("zones"), F.col("t.transaction_id").alias("transaction_id"), F.col("t.amount").cast("double").alias("amount"), F.col("t.link").isNotNull().alias("linked"),
    )
    full = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in ("entry_at", "zone_at", "billing_at")]) & F.col("linked")
    steps = reduce(lambda a, b: a + b, [F.col(x).isNotNull().cast("int") for x in ("entry_at", "zone_at", "billing_at", "purchase_at")])
    return j.withColumn("complete", full).withColumn("stage_count", steps)


def journey_order() -> list:
    """Complete ones first, then by amount, then by key. (T-07)"""
    return [F.desc("complete"), F.coalesce("amount", F.lit(0.0)).desc(), F.asc("store_id"), F.asc("visitor_key")]


def journey_summary(j: DataFrame, tx: DataFrame) -> DataFrame:
    """Linked and orphan purchases, complete journeys, and how many of those at billing have a purchase. (A-33)"""
    sold = tx.where("status = 'completed'")
    has = [c for c in ("link_method", "link_confidence") if c in tx.columns]
    link = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in has], F.lit(False))
    t = sold.groupBy("store_id").agg(F.count_if(_track().isNotNull() & link).alias("linked_purchases"), F.count_if(_track().isNull()).alias("orphan_purchases"))
    billed, bought = F.col("billing_at").isNotNull(), F.col("transaction_id").isNotNull()
    s = j.groupBy("store_id").agg(
        F.count("*").alias("journeys"), F.count_if("complete").alias("complete"), F.count_if(billed).alias("with_billing"),
        F.round(F.count_if(billed & bought) / F.nullif(F.count_if(billed), F.lit(0)), 4).alias("billing_to_purchase"),
    )
    return s.join(t, "store_id", "left")


def stage_overlap(sig: DataFrame) -> DataFrame:
    """Distinct visitors in pairs of stages. (J-12)"""
    v = sig.groupBy("store_id", "visitor_key").agg(*(F.max((F.col("stage") == s).cast("int")).alias(s) for s in C.STAGES))
    return v.groupBy("store_id").agg(
        F.sum(F.col("ENTRY") * F.col("ZONE_VISIT")).alias("entry_zone"), F.sum(F.col("ZONE_VISIT") * F.col("BILLING_QUEUE")).alias("zone_billing"), F.sum(F.col("ENTRY") * F.col("BILLING_QUEUE")).alias("entry_billing")
    )


def stage_audit(events: DataFrame, tx: DataFrame) -> DataFrame:
    """Raw zone entries and distinct tracks of each stage; purchases count as tracks. (A-43, U-01)

    Tracks are counted once by (store, stage, track) first, so counts merge before the exchange.
    """
    e = events.where((F.col("event_type") == C.ENTERED) & C.is_customer_track()).select("store_id", "external_track_id", C.lookup(C.ZONE_STAGES, F.lower("zone_type")).alias("stage")).where("stage is not null")
    zones = e.groupBy("store_id", "stage", "external_track_id").count().groupBy("store_id", "stage").agg(F.sum("count").alias("raw_events"), F.count("*").alias("distinct_tracks"))
    sold = tx.where("status = 'completed'").groupBy("store_id").agg(F.lit("PURCHASE").alias("stage"), F.lit(0).cast("long").alias("raw_events"), F.count("*").alias("distinct_tracks"))
    return zones.unionByName(sold)


def missing_sessions(events: DataFrame, tx: DataFrame, period: DataFrame) -> DataFrame:
    """(store_id, session_id) that events or purchases name and the period's sessions don't hold. (U-03)"""
    ids = lambda df: df.select("store_id", "session_id").where("session_id is not null")
    return ids(events).union(ids(tx)).distinct().join(period.select("store_id", "session_id"), ["store_id", "session_id"], "left_anti")


def sessions_by_id(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """(J-15)"""
    return sessions.join(ids.select("store_id", "session_id"), ["store_id", "session_id"], "left_semi")


def backfill_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events without a session take the one of their track. (K-09)"""
    known = sessions.groupBy("store_id", "external_track_id").agg(F.max_by("session_id", "started_at").alias("found_session"))
    return events.join(known, ["store_id", "external_track_id"], "left").withColumn("session_id", F.coalesce("session_id", "found_session")).select(*events.columns)
