"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_frozen, frozen, join_salted

#: Links, about, that one task of a step holds; a file for each task is what a step leaves.
TASK_LINKS = 1 << 18


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node named by `edges` (a, b); component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step hangs
    nodes below smaller ones, and a logarithmic number of them leaves one star a component.
    Minima are pre-aggregated, and joined back in parts where a node has very many neighbours,
    so a hub's neighbours never meet in one task. Steps are dealt out by the number of links,
    not by that of shuffle partitions: on file systems without native code each file costs the
    executor several processes, and there are dozens of steps. Nulls and self-links are ignored;
    no edges give no rows.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism

    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(max(cores, -(-count // TASK_LINKS)))

    pairs = frozen(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen, count = None, pairs.count()
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("uses"))
        large = join_salted(both, low, ["u"], "uses", ["v"], 2 * count).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = frozen(few(large))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("uses"))
        small = join_salted(large, low, ["u"], "uses", ["v"], count)
        old, pairs = pairs, frozen(
            few(
                small.select("u", F.col("m").alias("v"))
                .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                .distinct()
            )
        )
        drop_frozen(old)
        drop_frozen(large)
        now = pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            break
        seen, count = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    tops = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(tops)
