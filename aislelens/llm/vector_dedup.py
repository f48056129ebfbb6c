"""Embedding near-duplicates through a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_frozen, frozen, join_salted
from .components import connected_components

#: Reference points grow with the square root of the largest label, within these bounds: lists are by pairs of points, so
#: a list's expected length stays as it is. MOST_PIVOTS * SPARE vectors at most are sampled and broadcast.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS, SPARE = 13, 32, 1024, 4
#: Points with a larger cosine to one chosen before are left out: those inside one dense group would all be near its members, in any order.
APART = 0.7
#: A vector is filed under each pair of its NEAREST points, so two vectors meet if they share two of them.
NEAREST = 4
#: Members of an inverted list that one side of a task holds.
CHUNK = 1024


def pivot_count(largest: int) -> int:
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, (largest / PER_PIVOT) ** 0.5)))


def pick_pivots(sample: list[np.ndarray], count: int) -> list[np.ndarray]:
    """At most `count` of the sample, each length of vector by itself, scaled to length 1 and no two nearer than APART."""
    out: list[np.ndarray] = []
    for dim in {len(v) for v in sample}:
        kept = np.zeros((0, dim))
        for v in sample:
            u = v / np.linalg.norm(v) if len(v) == dim else None
            if u is not None and len(kept) < count and (not len(kept) or (kept @ u).max() < APART):
                kept = np.vstack([kept, u])
        out += list(kept)
    return out


def _describe(pivots: list[np.ndarray]):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nearest points of each vector in their order (near), and the pairs of them as list numbers (lists)."""
        for pdf in frames:
            order: list = [None] * len(pdf)
            lists: list = [None] * len(pdf)
            pdf = pdf.reset_index(drop=True)
            for dim, part in pdf.groupby("dim"):
                p = np.stack([x for x in pivots if len(x) == dim] or [np.ones(dim)])
                m = np.stack(part["e"].to_numpy())
                near = np.argsort(-(m @ p.T), axis=1, kind="stable")[:, :NEAREST].astype(np.int32)
                if near.shape[1] < 2:
                    near = np.hstack([near, near])
                up = np.sort(near, axis=1).astype(np.int64)
                i, j = np.triu_indices(near.shape[1], 1)
                pairs = up[:, i] * MOST_PIVOTS + up[:, j]
                for r, x, y in zip(part.index, near, pairs, strict=True):
                    order[r], lists[r] = x, y
            pdf["near"], pdf["lists"] = order, lists
            yield pdf

    return rows


def _compare(least: float):
    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of two chunks of one list, each pair in the list of the two smallest points that it shares."""
        pdf = pdf.sort_values(["side", "rep"], kind="stable")
        k = int((pdf["side"] == 0).sum())
        e = np.stack(pdf["e"].to_numpy())
        rep, copies, high = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), int(pdf["list"].iloc[0]) % MOST_PIVOTS
        near = np.unique(np.stack(pdf["near"].to_numpy()), return_inverse=True)
        names, place = near[0], near[1].reshape(len(pdf), -1)
        one = np.zeros((len(pdf), len(names)), np.float32)
        one[np.arange(len(pdf))[:, None], place] = 1
        # Shared points up to the list's second one: two (one if it is a point twice) if no smaller pair is shared.
        upto = one[:, names <= high]
        first = (upto[:k] @ upto.T) == (2 if int(pdf["list"].iloc[0]) // MOST_PIVOTS != high else 1)
        length = np.sqrt((e * e).sum(axis=1))
        cosine = (e[:k] @ e.T) / (length[:k, None] * length[None, :])
        # The matrix product only sifts; what decides is each pair's own sum.
        i, j = np.nonzero(first & (cosine >= least - 1e-9) & (rep[:k, None] != rep[None, :]))
        if (pdf["side"] == 0).all():
            i, j = i[i < j], j[i < j]
        good = np.ones(len(i), bool)
        for a in range(0, len(i), 1 << 16):
            x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            good[a : a + (1 << 16)] = (e[x] * e[y]).sum(axis=1) / (length[x] * length[y]) >= least
        i, j = i[good], j[good]
        n = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        # Links inside the task fold into one per vector: to the smallest one that they reach.
        low = np.arange(len(rep))
        while True:
            was = low.copy()
            np.minimum.at(low, i, was[j])
            np.minimum.at(low, j, was[i])
            low = np.minimum(low, low[low])
            if (low == was).all():
                break
        own = np.flatnonzero(n > 0)
        return pd.DataFrame({"rep": rep[own], "n": n[own].astype(np.int64), "low": rep[low[own]]})

    return cell


def embedding_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Rows of equal, not null labels are linked if their cosine, in doubles, is at least
    `least`. Equal vectors are one class that counts its copies. A class is described by the
    order of its NEAREST reference points; two classes are compared if they share two of them:
    they stand in an inverted list for each pair of points, and are held against each other in
    the list of the smallest pair they share. The number of points follows the size of the
    largest label (pivot_count), so that lists keep their length as tables grow. Long lists
    are cut into chunks, and every two chunks meet in a task of their own: nothing is left out
    of a list. A task returns a count and one link for each vector, not pairs. Pairs that share
    fewer than two points are missed; recall is measured in the tests.

    Null or zero vectors, ones with null or non-finite components, and rows with a null label or
    vec_id link with nothing (a null vec_id: null component, kept). Vectors of different
    lengths are not compared. Repeated rows are equal vectors. Other columns are not looked
    at, whatever their names. No rows give no rows.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").alias("label")
    ).withColumn("row_no", F.monotonically_increasing_id())
    # -0.0 and 0.0 are one number.
    rows = frozen(rows.withColumn("e", F.transform("e", lambda x: x + F.lit(0.0))).withColumn(
        "fine",
        F.expr("coalesce(vec_id is not null and label is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0), false)"),
    ))
    fine = rows.where("fine")
    classes = frozen(
        fine.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("e"))
    )
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    count = pivot_count(largest)
    sample = classes.orderBy(F.xxhash64("rep", "label")).limit(SPARE * count).select("e").collect()
    pivots = pick_pivots([np.array(r["e"]) for r in sample], count)
    filed = frozen(classes.mapInPandas(_describe(pivots), "label " + rows.schema["label"].dataType.simpleString() + ", e array<double>, rep long, copies long, dim int, near array<int>, lists array<long>"))
    drop_frozen(classes)
    entries = filed.select("label", "dim", "rep", F.explode("lists").alias("list"))
    # A list of one has no pairs, and its vector needn't travel.
    sizes = entries.groupBy("label", "dim", "list").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.expr(f"ceil(n / {CHUNK}D)"))
    cells = sizes.selectExpr("label", "dim", "list", "chunks", "explode(sequence(0L, chunks - 1)) as i").selectExpr("*", "explode(sequence(i, chunks - 1)) as j")
    sides = cells.selectExpr("label", "dim", "list", "i", "j", "i as chunk", "0 as side").union(
        cells.where("i <> j").selectExpr("label", "dim", "list", "i", "j", "j as chunk", "1 as side")
    )
    members = filed.withColumn("list", F.explode("lists")).drop("lists")
    # In parts where a list is long: the chunk is the part.
    placed = join_salted(members, sizes.withColumnRenamed("n", "uses"), ["label", "dim", "list"], "uses", ["rep"], filed.count() * NEAREST * (NEAREST - 1) // 2)
    placed = placed.withColumn("chunk", F.expr("pmod(xxhash64(rep), chunks)")).drop("chunks")
    full = placed.join(sides, ["label", "dim", "list", "chunk"])
    part = frozen(
        full.select("label", "dim", "list", "i", "j", "side", "rep", "copies", "e", "near")
        .groupBy("label", "dim", "list", "i", "j").applyInPandas(_compare(least), "rep long, n long, low long")
    )
    comps = connected_components(part.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    counts = part.groupBy("rep").agg(F.sum("n").alias("n"))
    named = filed.select("label", "e", "rep", "copies").join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").selectExpr(
        "label", "e", "copies as uses", "copies - 1 + coalesce(n, 0) as n_links", "coalesce(component, rep) as component_id"
    )
    linked = join_salted(fine.select("vec_id", "label", "e", "row_no"), named, ["label", "e"], "uses", ["row_no"], fine.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").selectExpr("vec_id", "0L as n_links", "vec_id as component_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
