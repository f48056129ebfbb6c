"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import SpanHash, bounded_batches, mix, passes, utf8

#: Hashed features. What is broadcast has at most that many weights, and L1 leaves few of them.
BITS = 20
#: Labelled rows that the classifier is fitted on, at most about: those of smallest hash of doc_id.
SAMPLE = 12_000
#: Features of all sampled rows together, at most: what the one training task holds (4 bytes each).
MOST_FEATURES = 32_000_000
#: FTRL-proximal: learning rate, its smoothing, L1 and L2; passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 10.0, 1.0, 6
#: Intercept without examples of both kinds.
NO_EXAMPLES = -5.0
#: Words between the two of a skip-gram.
SKIP = 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): words, pairs of neighbours and pairs around SKIP words of lower-cased UTF-8 rows.

    A word is a run of letters and digits (bytes from 0x80 on count as letters). `off` counts
    from the start of `data`.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = _WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:-1]
    stop[:-1] &= ~solid[1:] | cut[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    h = SpanHash(data)(start, end)
    row = np.searchsorted(off, start, "right") - 1
    rows, out = [row], [h]
    for gap in (1, 1 + SKIP):
        same = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
        pair = mix(h[:-gap][same] * np.uint64(0xFF51AFD7ED558CCD) + h[gap:][same] + np.uint64(gap)) if same.any() else np.zeros(0, np.uint64)
        rows.append(row[:-gap][same] if len(row) > gap else row[:0])
        out.append(pair)
    return np.concatenate(rows), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(pc.fill_null(column, "")))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = _lowered(batch.column("text"))
        for i, j in passes(off):
            row, f = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            both = np.unique(row << BITS | f)
            edge = np.searchsorted(both >> BITS, np.arange(j - i + 1))
            lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array((both & (1 << BITS) - 1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("toxic").slice(i, j - i), lists], ["doc_id", "toxic", "features"])


def fit_ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features with a weight, their weights, intercept), by per-coordinate FTRL-proximal steps (McMahan et al., 2013)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = n_bias = 0.0

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for x, y in zip(examples, labels.tolist(), strict=True):
            zi, ni = z[x], n[x]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-min(35.0, max(-35.0, w.sum() + bias))))
            g = p - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[x] = zi + g - sigma * w
            n[x] = ni + g * g
            n_bias += g * g
            bias -= ALPHA / (BETA + n_bias**0.5) * g
    kept = np.flatnonzero(np.abs(z) > L1)
    return kept, weight(z[kept], n[kept]).astype(np.float32), bias


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all examples, which are bounded in number: the intercept, then each weight."""
    ids, toxic, examples = [], [], []
    room = MOST_FEATURES
    for b in batches:
        lists = b.column("features")
        edge, values = np.asarray(lists.offsets), np.asarray(lists.values)
        fits = int(np.searchsorted(edge - edge[0], room, "right")) - 1
        room -= int(edge[fits] - edge[0])
        examples += [values[i:j] for i, j in zip(edge[:fits], edge[1 : fits + 1], strict=True)]
        ids.append(b.column("doc_id").to_numpy()[:fits])
        toxic.append(b.column("toxic").to_numpy()[:fits] > 0)
        if fits < b.num_rows:
            room = 0
    labels = np.concatenate([*toxic, np.zeros(0, bool)]).astype(float)
    kept, values, bias = np.zeros(0, np.int64), np.zeros(0, np.float32), NO_EXAMPLES
    if len(set(labels.tolist())) == 2:
        # An order that depends on the rows alone.
        ids = np.concatenate(ids)
        order = np.lexsort((labels, ids, mix(ids.view(np.uint64))))
        kept, values, bias = fit_ftrl([examples[i] for i in order], labels[order])
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, *kept.tolist()], pa.int32()), pa.array([0.0, *values.tolist()], pa.float32()), pa.array([bias] * (len(kept) + 1))], ["feature", "weight", "intercept"]
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from labels (doc_id, toxic) and docs (doc_id, text), on rows whose crc32(doc_id) mod 5 is not 0.

    At most about `sample` labelled rows are used, chosen by a hash of doc_id, and of these, in
    the order of that hash, as many as have MOST_FEATURES features together; a doc_id
    labelled twice counts as toxic if one row says so; null labels and doc_ids are left out.
    The sample is trained on in one task, and only weights come to the driver.
    Without examples of both kinds the model has no weights.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = int((1 << 20) * min(1.0, sample / max(1, n)))
    # A bounded set of ids, so that texts needn't be shuffled to find them.
    chosen = F.broadcast(known.where(f"pmod(xxhash64(doc_id), {1 << 20}) < {share}"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    rows = found.mapInArrow(_examples, "doc_id long, toxic int, features array<int>").repartition(1).sortWithinPartitions(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id", F.xxhash64("features")).mapInArrow(_train, "feature int, weight float, intercept double").collect()
    if not rows:  # nothing to learn from
        return np.zeros(0, np.int64), np.zeros(0, np.float32), NO_EXAMPLES
    return np.array([r["feature"] for r in rows[1:]], np.int64), np.array([r["weight"] for r in rows[1:]], np.float32), rows[0]["intercept"]


def _scorer(model: tuple[np.ndarray, np.ndarray, float]):
    kept, values, bias = model

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS, np.float32)
        weights[kept] = values
        for batch in batches:
            data, off = _lowered(batch.column("text"))
            score = np.zeros(batch.num_rows)
            for i, j in passes(off):
                row, f = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                some = weights[f] != 0
                both = np.unique(row[some] << BITS | f[some])
                score[i:j] = np.bincount(both >> BITS, weights[both & (1 << BITS) - 1], j - i)
            score = 1 / (1 + np.exp(-np.clip(score + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return rows


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    The score is a probability from a model fitted as fit() says; held_out rows (crc32 of
    doc_id as text mod 5 is 0) were not seen by it. Scores depend on the text alone. Null or
    empty text: the model's intercept. A null doc_id is not held out. Repeated rows score
    alike; a very long text is scored as a whole; an empty table gives no rows; other columns
    are not looked at.
    """
    model = fit(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, text string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns.

    score_toxicity() says how rows score. Columns may have any names: the row travels as one
    struct beside its text.
    """
    model = fit(docs, labels, sample)
    given = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (scored,) = _scorer(model)(iter([batch.select(["text"])]))
            yield batch.select(["row"]).filter(pc.less(scored.column("score"), 0.5))

    return given.mapInArrow(rows, StructType([StructField("row", docs.schema, False)])).select("row.*")
