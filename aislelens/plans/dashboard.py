"""The dashboard: one row a store from a few wide passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import metrics, visits, zones


def dashboard(events: DataFrame, tx: DataFrame) -> DataFrame:
    """(A-39) Events are read for KPIs, sessions and zones; each pass is one aggregation by track or zone, then by store."""
    sessions = visits.materialize_sessions(events, keep_staff=True)
    e, s, m = metrics.event_kpis(events, sessions), metrics.session_kpis(sessions), metrics.sales_kpis(tx)
    h = zones.heatmap_confidence(zones.heatmap(events)).drop("zones", "zone_visits")
    k = e.join(s, "store_id", "left").join(m, "store_id", "left").join(h, "store_id", "left")
    people = F.greatest("visitors", "session_visitors")
    ratio = F.round(F.least(F.lit(1.0), F.col("linked_purchases") / F.nullif(people, F.lit(0))), 4)
    return k.select(
        "store_id", people.alias("visitors"), "store_entries", "store_exits", "reentries", "queue_enters", F.col("customer_sessions").alias("sessions"), "staff_filtered", "purchases", "revenue",
        ratio.alias("conversion"), F.round(F.col("revenue") / F.nullif("purchases", F.lit(0)), 2).alias("aov"),
        F.round(F.col("linked_purchases") / F.nullif("purchases", F.lit(0)), 4).alias("linkage_rate"), F.col("confidence").alias("heatmap_confidence"), "weighted_dwell",
    )


def kpi_texts(d: DataFrame, currency: str = "₹") -> DataFrame:
    """(store_id, kpi, text): figures of the dashboard as they are shown. (F-20)"""
    none = lambda x, text: F.when(C.c(x).isNull(), "No data").otherwise(text)
    shown = [
        ("sessions", F.col("sessions").cast("string")), ("conversion_rate", C.percent("conversion")), ("revenue", C.money_text("revenue", currency)),
        ("average_basket_value", C.money_text("aov", currency)), ("queue_depth", F.col("queue_enters").cast("string")),
    ]
    source = {"conversion_rate": "conversion", "average_basket_value": "aov", "queue_depth": "queue_enters"}
    rows = F.array(*(F.struct(F.lit(n).alias("kpi"), none(source.get(n, n), text).alias("text")) for n, text in shown))
    return d.select("store_id", F.explode(rows).alias("x")).select("store_id", "x.*")


def reviewer_proof(coverage: DataFrame, kpis: DataFrame, sessions: DataFrame, sales: DataFrame, funnel: DataFrame, heat: DataFrame) -> DataFrame:
    """(store_id, name, passed): the eight checks of a store's data. (A-40)

    From metrics.coverage(), event_kpis(), session_kpis(), sales_kpis(), visits.funnel() and
    zones.heatmap_confidence().
    """
    n = lambda s: F.coalesce(F.max(F.when(F.col("stage") == s, F.col("visitors"))), F.lit(0))
    f = funnel.groupBy("store_id").agg(n("ENTRY").alias("f_entry"), n("BILLING_QUEUE").alias("f_billing"), n("PURCHASE").alias("f_purchase"), F.count("*").alias("stages"), F.sum("reentries").alias("again"))
    k = coverage.join(kpis, "store_id", "left").join(sessions, "store_id", "left").join(sales, "store_id", "left").join(f, "store_id", "left").join(heat, "store_id", "left")
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    came, left = F.greatest(z("store_entries"), z("f_entry"), z("customer_sessions")), F.greatest(z("store_exits"), z("session_exits"))
    checks = [
        ("5 CCTV videos processed", z("n_videos") >= 5), ("Vision events generated", z("events") > 0), ("Entries detected", came > 0), ("Exits detected", left > 0), ("Re-entry tracking", z("again") > 0),
        ("Conversion logic", (came > 0) & (z("f_purchase") <= came) & ((z("linked_purchases") > 0) | (z("f_billing") > 0))), ("Funnel engine", z("stages") >= 4), ("Heatmap zones", (z("zones") > 0) & (z("zone_visits") > 0)),
    ]
    return k.select("store_id", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), v.alias("passed")) for c, v in checks))).alias("x")).select("store_id", "x.*")


def ready_for_review(proof: DataFrame, needed: int = 6) -> DataFrame:
    """(store_id, checks_passed, checks_total, ready). (A-40)"""
    passed = F.count_if("passed")
    return proof.groupBy("store_id").agg(passed.alias("checks_passed"), F.count("*").alias("checks_total"), (passed >= needed).alias("ready"))
