"""Till lines and orders, and linking of orders with tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .asof import nearest
from .ordered import chains, ranked, settled, time_ranges


def parse_pos(lines: DataFrame, store_code: str) -> DataFrame:
    """Typed sale lines of one store from the raw text columns. (P-16, F-09..F-11)"""
    got = lines.where((F.col("store_id") == store_code) & (F.lower("invoice_type") == "sales"))
    qty = F.expr("cast(try_cast(nullif(trim(qty), '') as double) as int)")
    named = lambda c, other: F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)))
    return got.select(
        "order_id", "line_no", "invoice_number", "customer_name", "offer_name", named("brand_name", "Unknown").alias("brand_name"),
        F.concat_ws("/", named("dep_name", "unknown"), named("sub_category", "unknown")).alias("category"), F.coalesce(qty, F.lit(0)).alias("qty"),
        C.money("GMV").alias("gmv"), C.money("NMV").alias("nmv"), C.money("total_amount").alias("total_amount"), C.pos_time("order_date", "order_time").cast("timestamp_ntz").alias("occurred_at"),
    )


def orders(lines: DataFrame, attributes: tuple[str, ...] = ("brand_name",)) -> DataFrame:
    """Sums of each order, and attributes of its first line. (A-27)"""
    sums = [F.sum("nmv").cast("double").alias("nmv"), F.sum("gmv").cast("double").alias("gmv"), F.count("*").alias("line_count"), F.sum("qty").cast("long").alias("qty")]
    if "total_amount" in lines.columns:
        sums.append(F.sum("total_amount").cast("double").alias("total_amount"))
    first = F.min_by(F.struct(*attributes), F.struct("line_no", *attributes))
    return lines.groupBy("order_id").agg(*sums, first.alias("f")).select("*", *(F.col("f")[a].alias(f"first_{a}") for a in attributes)).drop("f")


def order_sequence() -> list:
    """(T-08)"""
    return [F.asc("first_occurred_at"), F.asc("order_id")]


#: Columns of a till export by what they tell.
POS_GROUPS = {
    "transaction": ("order_id", "invoice_number", "invoice_type", "return_id", "store_id", "store_name", "sku", "product_id", "qty"),
    "revenue": ("GMV", "NMV", "total_amount", "coupon_amount", "item_promotion", "amt_without_gwp", "taxable_amt", "tax_amt", "pb_eb_sale"),
    "product": ("product_name", "brand_name", "dep_name", "sub_category", "brand_type"),
    "time": ("order_date", "order_time"),
}


def column_profile(raw: DataFrame) -> DataFrame:
    """Lines, distinct orders, and how many columns of each group there are. (A-30)"""
    groups = [F.lit(sum(c in raw.columns for c in cols)).alias(f"{name}_columns") for name, cols in POS_GROUPS.items()]
    return raw.agg(F.count("*").alias("line_count"), F.countDistinct(F.nullif("order_id", F.lit(""))).alias("order_count"), F.lit(len(raw.columns)).alias("all_columns"), *groups)


def top_from_metadata(tx: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Revenue by brand or category, out of the JSON lists [{"name", "nmv"}] under `key` of completed purchases' metadata. (A-17, A-18)"""
    items = F.from_json(F.get_json_object("metadata", f"$.{key}"), "array<struct<name: string, nmv: string>>")
    x = tx.where("status = 'completed'").select(F.explode(items).alias("x")).select(F.col("x.name").alias("name"), C.money("x.nmv").alias("nmv")).where("name <> ''")
    return x.groupBy("name").agg(F.sum("nmv").cast("double").alias("nmv")).orderBy(F.desc("nmv"), "name").limit(n)


def order_parts(lines: DataFrame, by: str) -> DataFrame:
    """(A-28)"""
    return lines.groupBy("order_id", by).agg(F.sum("nmv").cast("double").alias("nmv"), F.count("*").alias("line_count"))


def top_by_revenue(lines: DataFrame, by: str, n: int = 5) -> DataFrame:
    """(A-29, T-01)"""
    return lines.groupBy(by).agg(F.sum("nmv").cast("double").alias("nmv"), F.count("*").alias("line_count")).orderBy(F.desc("nmv"), by).limit(n)


def top_per_order(lines: DataFrame, n: int = 5) -> DataFrame:
    """(T-02)"""
    b = order_parts(lines, "brand_name")
    return b.withColumn("rn", F.row_number().over(Window.partitionBy("order_id").orderBy(F.desc("nmv"), "brand_name"))).where(F.col("rn") <= n)


def totals(lines: DataFrame) -> DataFrame:
    """(A-29)"""
    return lines.agg(F.sum("nmv").cast("double").alias("revenue"), F.countDistinct("order_id").alias("orders"), F.count("*").alias("line_count"), F.round(F.sum("nmv").cast("double") / F.countDistinct("order_id"), 4).alias("aov"))


def billing_candidates(events: DataFrame) -> DataFrame:
    """(A-31)"""
    e = events.where((F.col("event_type") == C.ENTERED) & C.is_customer_track() & F.col("zone_type").isin(*C.QUEUE_ZONES))
    return e.groupBy("store_id", "external_track_id").agg(F.min("occurred_at").alias("billing_at"), F.count("*").alias("billing_events"))


def link_sequential(billing: DataFrame, tx: DataFrame) -> DataFrame:
    """i-th track with i-th order of a store. (J-06, W-12)"""
    b = ranked(billing.select("store_id", "external_track_id", "billing_at"), ["store_id"], ["billing_at", "external_track_id"])
    t = ranked(tx.where("status = 'completed'").select("store_id", "transaction_id", "occurred_at"), ["store_id"], ["occurred_at", "transaction_id"])
    return b.join(t, ["store_id", "rn"]).select("store_id", "external_track_id", "transaction_id", F.lit("SEQUENTIAL").alias("method"), F.lit(0.75).alias("confidence"))


def nearest_order(billing: DataFrame, tx: DataFrame, window_s: int = 3600) -> DataFrame:
    """The nearest order of each track within the window, orders not being used up, by an as-of join. (J-05, pure form)"""
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    width = window_s * 1_000_000
    t = tx.where("status = 'completed'").select("store_id", "transaction_id", us("occurred_at").alias("tt"))
    b = billing.select("store_id", "external_track_id", us("billing_at").alias("bt"))
    best = nearest(b, t, ["store_id"], "bt", "tt", ["transaction_id"], width).where("hit is not null")
    return best.select("store_id", "external_track_id", "hit.transaction_id", (F.col("hit.distance") / 1e6).alias("delta_s"), F.round(F.greatest(F.lit(0.0), 1 - F.col("hit.distance") / width), 3).alias("confidence"))


LINKS = "store_id string, external_track_id string, transaction_key string, method string, confidence double"
#: Rows of a chain that one task links; longer ones are linked in ranges.
MOST_IN_A_TASK = 200_000


def _matched(pdf: pd.DataFrame, window_s: int) -> list[tuple]:
    """(track, order, confidence): tracks (kind b) in order of time take the nearest order (t) left within the window, the earlier of two as near; orders of kind u are gone."""
    bills, sold = (pdf[pdf.kind == k].sort_values(["at", "key"]) for k in ("b", "t"))
    times, keys, free, out = sold["at"].to_numpy(), sold["key"].to_numpy(), ~sold["key"].isin(pdf[pdf.kind == "u"]["key"]).to_numpy(), []
    for at, key in zip(bills["at"], bills["key"], strict=True):
        lo, hi = np.searchsorted(times, at - window_s, "left"), np.searchsorted(times, at + window_s, "right")
        near = np.flatnonzero(free[lo:hi]) + lo
        if len(near):
            k = near[np.abs(times[near] - at).argmin()]
            free[k] = False
            out.append((key, keys[k], round(max(0.0, 1 - abs(times[k] - at) / window_s), 3)))
    return out


def link_in_ranges(rows: DataFrame, window_s: int) -> DataFrame:
    """Links of rows (store_id, chain, kind, key, at) of chains of any length, as one loop over each would give. (J-07)

    A chain is cut into time ranges, which are linked side by side as if no order were taken
    before; each sees its tracks and all orders within their reach. Then a range is told which of
    its orders ranges before it have taken, and those that hear something new are linked again,
    until none does. The first range is right at once, and each round makes the next one right,
    but as a rule few orders are taken over an edge and two or three rounds are enough.
    """
    group = ["store_id", "chain"]
    part = time_ranges(rows.select(*group, "kind", "key", "at"), group, ["at", "kind", "key"])
    bills = part.where("kind = 'b'")
    slot = lambda x: F.floor(x / window_s)
    spans = bills.groupBy(*group, "range_no").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).withColumn("slot", F.explode(F.sequence(slot(F.col("lo") - window_s), slot(F.col("hi") + window_s))))
    sold = part.where("kind = 't'").select(*group, "kind", "key", "at", slot(F.col("at")).alias("slot"))
    reach = sold.join(spans, [*group, "slot"]).where("at >= lo - {0} and at <= hi + {0}".format(window_s))
    work = settled(bills.select(*group, "range_no", "kind", "key", "at").union(reach.select(*group, "range_no", "kind", "key", "at")))
    orders_ = work.where("kind = 't'").select(*group, "range_no", "key")

    def match(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *m) for m in _matched(pdf, window_s)], columns=["store_id", "chain", "range_no", "track", "key", "confidence"])

    schema = "store_id string, chain long, range_no int, track string, key string, confidence double"
    place = [*group, "range_no"]
    links, heard = None, None
    while True:
        if links is None:
            todo, taken = work, work.where("false").select(*place, "key")
        else:
            used = links.select(*group, F.col("range_no").alias("by_range"), "key")
            taken = settled(orders_.join(used, [*group, "key"]).where("range_no > by_range").select(*place, "key").distinct())
        news = settled(taken.groupBy(*place).agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("mark")))
        if links is not None:
            before = heard.withColumnRenamed("n", "n_").withColumnRenamed("mark", "mark_")
            new = news.join(before, place, "full").where(~(F.col("n").eqNullSafe(F.col("n_")) & F.col("mark").eqNullSafe(F.col("mark_")))).select(*place)
            new = settled(new)
            if new.isEmpty():
                break
            todo = work.join(new, place, "left_semi").union(taken.join(new, place, "left_semi").select(*place, F.lit("u").alias("kind"), "key", F.lit(None).cast("double").alias("at")))
        again = todo.groupBy(*place).applyInPandas(match, schema)
        links = settled(again if links is None else links.join(new, place, "left_anti").union(again))
        heard = news
    return links.select("store_id", F.col("track").alias("external_track_id"), F.col("key").alias("transaction_key"), F.lit("TIME_WINDOW").alias("method"), "confidence")


def link_orders(billing: DataFrame, tx: DataFrame, window_s: int = 1200, offset_s: int = 0, mode: str = "AUTO", most: int = MOST_IN_A_TASK) -> DataFrame:
    """Greedy one-to-one matching in time order, leftovers paired in sequence. (J-05, J-07, U-04)

    A track takes the nearest order left within the window, the earlier of two as near; tracks
    go in the order of time. A choice depends on those before it only through orders within
    reach, so times more than a window apart never touch: stores are cut at such gaps into
    chains, and a chain of at most `most` rows is a task; a longer one is linked in ranges, with
    the same result. Gaps are found by time ranges, so no task sees a store.
    """
    us = lambda x, more=0: F.unix_micros(F.col(x).cast("timestamp")) / 1e6 + more
    t = tx.where("status = 'completed'").select("store_id", F.lit("t").alias("kind"), F.col("transaction_id").cast("string").alias("key"), us("occurred_at", offset_s).alias("at"))
    b = billing.select("store_id", F.lit("b").alias("kind"), F.col("external_track_id").alias("key"), us("billing_at").alias("at"))
    both = settled(chains(b.unionByName(t), ["store_id"], "at", ["kind", "key"], window_s))  # read several times

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(pdf["store_id"].iloc[0], track, key, "TIME_WINDOW", confidence) for track, key, confidence in _matched(pdf, window_s)]
        return pd.DataFrame(found, columns=[x.split()[0] for x in LINKS.split(", ")])

    # Most chains hold one kind alone and have nothing to match.
    pairs = both.groupBy("store_id", "chain").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    short = pairs.where(F.col("n") <= most).select("store_id", "chain")
    timed = both.join(short, ["store_id", "chain"], "left_semi").groupBy("store_id", "chain").applyInPandas(match, LINKS)
    long_ = pairs.where(F.col("n") > most).select("store_id", "chain")
    if not long_.isEmpty():
        timed = timed.union(link_in_ranges(both.join(long_, ["store_id", "chain"], "left_semi"), window_s))
    if mode == "TIME_WINDOW":
        return timed
    named = lambda df: df.select("store_id", "external_track_id", F.col("transaction_id").cast("string").alias("transaction_key"), "method", "confidence")
    if mode == "SEQUENTIAL":
        return named(link_sequential(billing, tx))
    timed = settled(timed)  # read three times
    left_b = billing.join(timed.select("store_id", "external_track_id"), ["store_id", "external_track_id"], "left_anti")
    left_t = tx.withColumn("transaction_key", F.col("transaction_id").cast("string")).join(timed.select("store_id", "transaction_key"), ["store_id", "transaction_key"], "left_anti")
    return timed.unionByName(named(link_sequential(left_b, left_t)))


def backfill_tracks(purchases: DataFrame, links: DataFrame) -> DataFrame:
    """Purchase events and orders (store_id, order_id, ...) take the track, and session, of the linked transaction of their order. (J-13, K-09)"""
    kept = [F.max_by("external_track_id", "occurred_at").alias("linked")] + ([F.max_by("session_id", "occurred_at").alias("linked_session")] if "session_id" in links.columns else [])
    known = links.where("external_track_id is not null").groupBy("store_id", "order_id").agg(*kept)
    out = purchases.join(known, ["store_id", "order_id"], "left").withColumn("external_track_id", F.coalesce("linked", "external_track_id"))
    if "session_id" in links.columns and "session_id" in purchases.columns:
        out = out.withColumn("session_id", F.coalesce("linked_session", "session_id"))
    return out.select(*purchases.columns)


def latest_session_by_track(sessions: DataFrame) -> DataFrame:
    """(S-22)"""
    return sessions.where("external_track_id is not null").groupBy("store_id", "external_track_id").agg(F.max(F.struct("started_at", "session_id")).alias("x")).select("store_id", "external_track_id", "x.session_id")


def funnel_ratios(stages: DataFrame, revenue: DataFrame) -> DataFrame:
    """(store_id, stage, visitors) and (store_id, revenue) -> billing to purchase and purchase rate, capped and raw, revenue a visitor. (A-66)"""
    n = lambda s: F.max(F.when(F.col("stage") == s, F.col("visitors")))
    k = stages.groupBy("store_id").agg(n("ENTRY").alias("v"), n("BILLING_QUEUE").alias("b"), n("PURCHASE").alias("p")).join(revenue, "store_id", "left")
    over = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    v, b, p = F.col("v"), F.col("b"), F.col("p")
    return k.select(
        "store_id", over(F.least(p, b), b).alias("billing_to_purchase"), over(p, b).alias("billing_to_purchase_raw"), over(F.least(p, v), v).alias("purchase_rate"), over(p, v).alias("purchase_rate_raw"),
        F.coalesce(F.round(F.col("revenue") / F.nullif(v, F.lit(0)), 6), F.lit(0.0)).alias("revenue_per_visitor"),
    )


def time_slice(orders_: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Orders and revenue from a time on, or up to another. (A-66)"""
    at = F.col("occurred_at")
    inside = (at >= F.lit(start).cast("timestamp_ntz")) & (at <= F.lit(end).cast("timestamp_ntz") if end else F.lit(True))
    return orders_.where(inside).groupBy("store_id").agg(F.count("*").alias("orders"), F.sum("amount").cast("double").alias("revenue"))
