"""Exact top-k by inner product: document-range blocks in the order of their summed term maxima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_frozen, frozen

#: Rows of a block, rows that are cut into blocks together, blocks of a shard, queries of a batch: what one task holds at once.
BLOCK, GROUP, SHARD, BATCH = 64, 8192, 512, 8192
#: Reference points that order rows into groups of neighbours, taken from a bounded sample.
POINTS = 64


def _floor_rows(embedding: str) -> str:
    x = f"transform({embedding}, x -> floor(cast(x as double) * 256))"
    return f"transform({x}, x -> cast(x as double))"


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: doubles while every partial sum is below 2**53, Python integers else (held to the range of a long)."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    wide = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    lo, hi = -(2**63), 2**63 - 1
    return np.array([[min(hi, max(lo, sum(x * y for x, y in zip(r, s, strict=True)))) for s in wide[1]] for r in wide[0]], np.int64).reshape(len(a), len(b))


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] >= k else np.full(len(score), np.iinfo(np.int64).min)


def _neighbours(m: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of m in blocks of at most `size`: halved at the median of the widest component, again and again."""
    out, open_ = [], [np.arange(len(m))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            out.append(np.sort(rows))
            continue
        part = m[rows]
        wide = int((part.max(axis=0) - part.min(axis=0)).argmax()) if m.shape[1] else 0
        order = rows[np.argsort(part[:, wide], kind="stable")] if m.shape[1] else rows
        half = size * max(1, round(len(rows) / 2 / size))
        open_ += [order[half:], order[:half]]
    return out


def _build(k: int, every: int, size: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        """Blocks of neighbouring rows: forward indexes, term minima and maxima, and a first bound for their own queries."""
        pdf = pdf.sort_values("vec_id", kind="stable")
        all_ids, all_m = pdf["vec_id"].to_numpy(), np.stack(pdf["v"].to_numpy()) if len(pdf["v"].iloc[0]) else np.zeros((len(pdf), 0))
        out = []
        for rows in _neighbours(all_m, size):
            ids, m = all_ids[rows], all_m[rows]
            ask = np.flatnonzero(ids % every == 0)
            floor = np.full(len(ids), np.iinfo(np.int64).min)
            if len(ask):
                # The whole group is at hand: its k-th score bounds the answer from below.
                score = _product(m[ask], all_m)
                score[ids[ask][:, None] == all_ids[None, :]] = np.iinfo(np.int64).min
                floor[ask] = _kth(score, k)
            out.append((int(pdf["dim"].iloc[0]), int(pdf["point"].iloc[0]), ids.tobytes(), m.tobytes(), m.min(axis=0).tobytes(), m.max(axis=0).tobytes(), ids[ask].tobytes(), m[ask].tobytes(), floor[ask].tobytes(), len(ask)))
        return pd.DataFrame(out, columns=["dim", "point", "ids", "rows", "low", "high", "q_ids", "q_rows", "q_floor", "asked"])

    return block


def _taken(column: pd.Series, kind: type, dim: int) -> np.ndarray:
    """Rows of `dim` numbers, one behind the other, from a column of bytes."""
    return np.frombuffer(b"".join(column), kind).reshape(-1, dim) if dim else np.zeros((len(column), 0))


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Summed term maxima: a positive weight meets a block's maximum, a negative one its minimum; a little more for rounding."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T + 1e-9 * (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T)


def _prune(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Blocks of a shard whose bound reaches the first k-th score of any query of a batch; `live` counts these queries."""
    if not len(blocks) or not len(queries):
        return pd.DataFrame({"block": [], "batch": [], "live": []}).astype("int64")
    dim = int(blocks["dim"].iloc[0])
    low, high = (_taken(blocks[c], np.float64, dim) if dim else np.zeros((len(blocks), 0)) for c in ("low", "high"))
    floor = _taken(queries["q_floor"], np.int64, 1)[:, 0]
    q = _taken(queries["q_rows"], np.float64, dim) if dim else np.zeros((len(floor), 0))
    live = (_bounds(q, low, high) >= floor[:, None]).sum(axis=0)
    return pd.DataFrame({"block": blocks["block"].to_numpy(), "batch": np.full(len(blocks), queries["q_batch"].iloc[0]), "live": live})[live > 0]


def _search(k: int):
    def cell(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """Queries of a batch against the blocks of a shard."""
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(blocks) or not len(queries):
            return empty
        dim = int(blocks["dim"].iloc[0])
        q_ids, floor = _taken(queries["q_ids"], np.int64, 1)[:, 0], _taken(queries["q_floor"], np.int64, 1)[:, 0]
        q = _taken(queries["q_rows"], np.float64, dim) if dim else np.zeros((len(q_ids), 0))
        low, high = (_taken(blocks[c], np.float64, dim) if dim else np.zeros((len(blocks), 0)) for c in ("low", "high"))
        bound = _bounds(q, low, high)
        rank = np.argsort(-bound, axis=1, kind="stable")
        best = np.full((len(q), k), np.iinfo(np.int64).min)
        who = np.full((len(q), k), np.iinfo(np.int64).max)
        ids = [np.frombuffer(b, np.int64) for b in blocks["ids"]]
        rows = [np.frombuffer(b, np.float64).reshape(len(i), dim) for b, i in zip(blocks["rows"], ids, strict=True)]
        live = np.arange(len(q))
        for step in range(len(blocks)):
            # A block may still hold a row that ties with the k-th score, so only lower bounds end a query.
            live = live[bound[live, rank[live, step]] >= np.maximum(floor[live], best[live, k - 1])]
            if not len(live):
                break
            for b in np.unique(rank[live, step]):
                at = live[rank[live, step] == b]
                score = _product(q[at], rows[b])
                score[q_ids[at][:, None] == ids[b][None, :]] = np.iinfo(np.int64).min
                if score.shape[1] > 4 * k:
                    edge = np.maximum(_kth(score, k), best[at, k - 1])
                    keep = (score >= edge[:, None]).any(axis=0)
                    score, names = score[:, keep], ids[b][keep]
                else:
                    names = ids[b]
                all_s = np.concatenate([best[at], score], axis=1)
                all_w = np.concatenate([who[at], np.broadcast_to(names, score.shape)], axis=1)
                all_w = np.where(all_s == np.iinfo(np.int64).min, np.iinfo(np.int64).max, all_w)
                order = np.lexsort((all_w, ~all_s), axis=1)[:, :k]
                best[at], who[at] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_w, order, 1)
        found = who != np.iinfo(np.int64).max
        r = np.nonzero(found)[0]
        return pd.DataFrame({"query_id": q_ids[r], "vec_id": who[found], "score": best[found]})

    return cell


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, shard: int = SHARD, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) whose vec_id is divisible by
    `every`, the `k` other rows of largest inner product of floor(256 * component), ties to the smaller vec_id.

    Rows are grouped by their nearest of POINTS reference points (of a bounded sample) and cut
    into blocks of `block` neighbours. A block is one record: forward indexes and the extremes
    of each component. A query bounds a block by the sum of its weights times these extremes;
    its own group gives a first k-th score. Only bounds and queries are exchanged at first, in
    shards and batches; a block travels to the batches where its bound reaches some query's
    k-th score. There each query goes through blocks from the highest bound down, and stops
    when bounds fall below its k-th score. A task holds `batch` queries and `shard` blocks.

    Null vectors and ones with null or non-finite components take no part; nor do rows with a
    null vec_id. Vectors of different lengths are not compared. Rows of equal vec_id and equal floored
    vector are one row. If a vec_id repeats with different vectors, each is a row: a query
    with that id is asked once for each, with the k best of all its answers, and rows of its
    id are its own. Scores beyond the
    range of a long stay at its end. Fewer than k others give fewer rows; none give none. Other
    columns are not looked at, whatever their names.
    """
    blocks, queries, bounds = _exchanged(vectors, k, every, block, shard, batch)
    live = bounds.groupBy("dim", "shard", "batch").cogroup(queries.groupBy("q_dim", "q_shard", "q_batch")).applyInPandas(_prune, "block long, batch long, live long")
    left = blocks.select("block", "dim", "shard", "ids", "rows", "low", "high").join(live.drop("live"), "block")
    found = left.groupBy("dim", "shard", "batch").cogroup(queries.groupBy("q_dim", "q_shard", "q_batch")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    # Each shard has k rows a query at most; a sorted list is merged before and after the exchange.
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id", "score"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def skipped_share(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, shard: int = SHARD, batch: int = BATCH) -> float:
    """Share of pairs of query and block that bounds alone put out before any block travels: how well vectors lend themselves to pruning."""
    _, queries, bounds = _exchanged(vectors, k, every, block, shard, batch)
    live = bounds.groupBy("dim", "shard", "batch").cogroup(queries.groupBy("q_dim", "q_shard", "q_batch")).applyInPandas(_prune, "block long, batch long, live long")
    asked = queries.groupBy("q_dim", "q_shard").agg(F.sum(F.length("q_floor") / 8).alias("asked"))
    pairs = bounds.where("batch = 0").join(asked, (F.col("dim") == F.col("q_dim")) & (F.col("shard") == F.col("q_shard"))).agg(F.sum("asked")).first()[0]
    return 1 - (live.agg(F.sum("live")).first()[0] or 0) / pairs if pairs else 0.0


def _exchanged(vectors: DataFrame, k: int, every: int, block: int, shard: int, batch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written blocks; queries, a copy for each shard; bounds of blocks, a copy for each batch."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(
        "vec_id is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    ).select("vec_id", F.size("e").alias("dim"), F.expr(_floor_rows("e")).alias("v"))
    sample = usable.orderBy(F.xxhash64("vec_id")).limit(POINTS).select("v").collect()
    points = [np.array(r["v"]) for r in sample]

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf["point"] = 0
            for dim, part in pdf.groupby("dim"):
                p = [x for x in points if len(x) == dim]
                if p and dim:
                    p, m = np.stack(p), np.stack(part["v"].to_numpy())
                    pdf.loc[part.index, "point"] = (m @ p.T - (p * p).sum(axis=1) / 2).argmax(axis=1)
            yield pdf

    placed = frozen(usable.dropDuplicates(["vec_id", "v"]).mapInPandas(near, "vec_id long, dim int, v array<double>, point long"))
    sizes = placed.groupBy("dim", "point").agg(F.ceil(F.count("*") / F.lit(GROUP)).alias("parts"))
    cut = placed.join(F.broadcast(sizes), ["dim", "point"]).withColumn("part", F.expr("pmod(xxhash64(vec_id), parts)"))
    blocks = frozen(
        cut.groupBy("dim", "point", "part")
        .applyInPandas(_build(k, every, block), "dim int, point long, ids binary, rows binary, low binary, high binary, q_ids binary, q_rows binary, q_floor binary, asked long")
        .withColumn("block", F.monotonically_increasing_id())
    )
    drop_frozen(placed)
    total = blocks.groupBy("dim").agg(F.count("*").alias("blocks"), F.sum("asked").alias("all_asked"))
    total = F.broadcast(total.selectExpr("dim", f"ceil(blocks / {shard}D) as shards", f"ceil(all_asked / {batch}D) as batches"))
    built = blocks
    blocks = frozen(built.join(total, "dim").where("batches > 0").withColumn("shard", F.expr("pmod(xxhash64(block), shards)")))
    drop_frozen(built)
    bounds = blocks.select("dim", "block", "low", "high", "shard", F.expr("explode(sequence(0L, batches - 1))").alias("batch"))
    # Queries near one point are one batch, or as many as they fill: bounds that leave a block out for one leave it out for all.
    near_by = F.broadcast(blocks.groupBy("dim", "point").agg(F.ceil(F.sum("asked") / F.lit(batch)).alias("fills")))
    asked = blocks.where("asked > 0").join(near_by, ["dim", "point"]).withColumn("q_batch", F.expr("pmod(xxhash64(point, pmod(xxhash64(block, 1), fills)), batches)"))
    queries = asked.select(F.col("dim").alias("q_dim"), "q_ids", "q_rows", "q_floor", "q_batch", F.expr("explode(sequence(0L, shards - 1))").alias("q_shard"))
    return blocks, queries, bounds
