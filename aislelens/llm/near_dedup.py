"""MinHash near-duplicate groups: fast similarity sketching, banding, exact verification.

The sketch (Dahlgaard, Knudsen and Thorup, 2017) throws every shingle into one of ``BINS``
bins a round and keeps the smallest value of a bin, a value's leading part being its round;
rounds 0 to BINS-1 choose the bin by hash, round BINS+i puts everything into bin i, so each
coordinate fills. A round that finds all bins full changes nothing, and later ones are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_frozen, frozen, join_salted, mix, passes, signed, utf8, word_hashes
from .components import connected_components

BINS = 128
#: 32 bands of 4: a pair of similarity 0.85 shares no band with probability 6e-11, one of 0.8 with 5e-8.
BAND_ROWS = 4
#: Documents and shingles, about, of a bucket that one verification task holds at once, a side.
CHUNK, CHUNK_SHINGLES = 512, 1 << 19
#: Members and shingles, about, of a star that are verified together.
STAR, STAR_SHINGLES = 256, 1 << 18
WIDTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xFF51AFD7ED558CCD)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row; `off` counts from the start of `data`."""
    h, first = word_hashes(data, off)
    count = np.diff(first)
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width if len(rolled) else 0):
        rolled = (rolled ^ h[k : k + len(rolled)]) * _M
        rolled ^= rolled >> np.uint64(29)
    rolled = mix(rolled + np.uint64(width))
    out = []
    for a, n in zip(first[:-1].tolist(), count.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[a : a + n - width + 1]))
        elif n:
            one = np.zeros(1, np.uint64)
            for k in range(n):
                one = (one ^ h[a + k : a + k + 1]) * _M
                one ^= one >> np.uint64(29)
            out.append(mix(one + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of `bins` 64-bit values for each set; rows of empty sets mean nothing."""
    size = np.array([len(s) for s in sets], np.int64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * bins, full, np.uint64)
    x, owner = (np.concatenate(sets), np.repeat(np.arange(len(sets)), size)) if len(sets) else (np.zeros(0, np.uint64), size)
    for r in range(2 * bins):
        if not len(x):
            break
        with np.errstate(over="ignore"):
            h = mix(x + _STEP * np.uint64(r + 1))
        slot = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if r < bins else r - bins
        np.minimum.at(out, owner * bins + slot, np.uint64(r << 32) | (h & np.uint64(0xFFFFFFFF)))
        open_ = (out.reshape(-1, bins) == full).any(axis=1)
        keep = open_[owner]
        if not keep.all():
            x, owner = x[keep], owner[keep]
    return out.reshape(-1, bins)


def bands(sketch: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit key a band, which also holds the band's number."""
    parts = sketch.reshape(len(sketch), sketch.shape[1] // rows, rows)
    key = np.tile(np.arange(parts.shape[1], dtype=np.uint64), (len(sketch), 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix((key ^ parts[:, :, k]) * _M)
    return key


def _print(sets: list[np.ndarray], salt: int) -> np.ndarray:
    return signed(np.array([mix(s + np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in passes(off):
            sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
            some = np.array([len(s) > 0 for s in sets], bool)
            keys = bands(sketches([s for s in sets if len(s)]))
            each = np.zeros((len(sets), keys.shape[1] if len(keys) else 0), np.uint64)
            if len(keys):
                each[some] = keys
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(some * each.shape[1])]).astype(np.int32)), pa.array(signed(each[some].ravel()))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(_print(sets, 1)), pa.array(_print(sets, 2)), lists],
                ["doc_id", "n_shingles", "p", "q", "bands"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in passes(off):
            sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").slice(i, j - i), pa.array(_print(sets, 1)), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "p", "hashes"]
            )


def _shared(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Intersection sizes of the first k sets with all, exactly, by blocks of a 0/1 incidence matrix."""
    size = np.array([len(s) for s in sets])
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, use = np.repeat(np.arange(len(sets)), size), count[inverse] > 1
    owner, inverse = owner[use], inverse[use]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    column = np.cumsum(np.concatenate([[False], np.diff(inverse) > 0])) if len(inverse) else inverse
    out = np.zeros((k, len(sets)), np.float64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        out += m[:k] @ m.T
    return out


def _linked(shared: np.ndarray, n: np.ndarray, k: int, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n[:k, None] + n[None, :] - shared)


def _verify_star(percent: int):
    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        """Every member against the hub, on full sets."""
        pdf = pdf.sort_values("hub", ascending=False, kind="stable")
        sets = [np.frombuffer(b, np.uint64) for b in pdf["hashes"]]
        rep = pdf["rep"].to_numpy()
        n = np.array([len(s) for s in sets], np.float64)
        held = np.concatenate([[0], np.cumsum(np.isin(np.concatenate(sets), sets[0]))])
        cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        shared = (held[cut[1:]] - held[cut[:-1]]).astype(np.float64)[None, :]
        good = _linked(shared, n, 1, percent)[0]
        good[0] = False
        return pd.DataFrame({"a": rep[good], "b": np.full(int(good.sum()), rep[0])})

    return check


def _verify_cell(percent: int):
    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between different components of two chunks; one link for each pair of components."""
        pdf = pdf.sort_values(["side", "rep"], kind="stable")
        k = int((pdf["side"] == 0).sum())
        sets = [np.frombuffer(b, np.uint64) for b in pdf["hashes"]]
        comp, rep = pdf["component"].to_numpy(), pdf["rep"].to_numpy()
        n = np.array([len(s) for s in sets], np.float64)
        good = _linked(_shared(sets, k), n, k, percent) & (comp[:k, None] != comp[None, :])
        i, j = np.nonzero(good)
        found = pd.DataFrame({"a": rep[i], "b": rep[j], "ca": np.minimum(comp[i], comp[j]), "cb": np.maximum(comp[i], comp[j])})
        return found.drop_duplicates(["ca", "cb"])[["a", "b"]]

    return check


def _parts(rows: str, shingles: str, most: int, most_shingles: int) -> Column:
    """How many parts hold at most about `most` rows and `most_shingles` shingles each."""
    return F.ceil(F.greatest(F.col(rows) / F.lit(most), F.col(shingles) / F.lit(most_shingles)))


def near_duplicates(
    docs: DataFrame, percent: int = 85, star: tuple[int, int] = (STAR, STAR_SHINGLES), chunk: tuple[int, int] = (CHUNK, CHUNK_SHINGLES)
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct
    five-word shingles (words: maximal runs without 0x20 and 0x09-0x0D, A-Z in lower case).
    component_id is the smallest doc_id that links reach; kept tells the one row to keep.

    1. One scan gives each row its set size, a 128-bit print of the set, and 32 band keys.
    2. Equal sets form one class with its smallest doc_id, so copies cost one row each.
    3. Classes that share a band key are held against the smallest one of the bucket (a star).
    4. Buckets that still span several components are split into chunks, and all pairs of
       chunks that may hold two components are compared by a 0/1 matrix product in memory.
    All links are confirmed on the full sets. No pair list is emitted, and no bucket has a cap.
    Stars and chunks are split by rows and by shingles, `star` and `chunk` being the most of
    each, so a task's memory doesn't follow the longest texts' number; buckets, hubs and classes
    of very many rows are joined in parts.

    Null or empty text, or text without words: n_shingles 0, linked with nothing. A null
    doc_id links with nothing, has a null component and is kept. Repeated rows are copies;
    rows with one doc_id and different texts are one document with several sets. A very long
    text has one large set. Other columns are not looked at, whatever their names. An empty
    table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = frozen(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, p long, q long, bands array<long>"))
    same, whole = ["p", "q", "n_shingles"], sigs.where("doc_id is not null and n_shingles > 0")
    classes = frozen(whole.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    firsts = whole.select(*same, "doc_id", "bands").join(classes.select(*same, F.col("rep").alias("doc_id")), [*same, "doc_id"], "left_semi")
    firsts = frozen(firsts.dropDuplicates([*same, "doc_id"]).select(F.col("doc_id").alias("rep"), "p", F.col("n_shingles").alias("n"), "bands"))
    entries = firsts.select("rep", "p", "n", F.explode("bands").alias("bucket"))
    shared = frozen(
        entries.groupBy("bucket").agg(F.min(F.struct("rep", "p", "n")).alias("hub"), F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1").withColumn("uses", F.col("members"))
    )
    members = frozen(join_salted(entries, shared, ["bucket"], "uses", ["rep", "p"]))
    drop_frozen(firsts)
    drop_frozen(shared)

    wanted = members.select("rep").distinct()
    sets = docs.withColumnRenamed("doc_id", "rep").join(wanted, "rep", "left_semi").mapInArrow(_set_rows, "rep long, p long, hashes binary")
    sets = frozen(sets.dropDuplicates(["rep", "p"]))

    def with_sets(load: DataFrame, salt: list[str]) -> DataFrame:
        """load (rep, p, ...) with the hashes of each; a set that very many tasks ask for is joined in parts."""
        load = frozen(load)
        uses = load.groupBy("rep", "p").agg(F.count("*").alias("uses"))
        return join_salted(load, sets.join(uses, ["rep", "p"]), ["rep", "p"], "uses", salt, load.count())

    stars = members.where(f"(rep, p) <> (hub.rep, hub.p) and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
    stars = frozen(stars.selectExpr("rep", "p", "n", "hub.rep as hub", "hub.p as hub_p").distinct())
    many = stars.groupBy("hub", "hub_p").agg(F.count("*").alias("uses"), F.sum("n").alias("shingles")).withColumn("parts", _parts("uses", "shingles", *star)).drop("shingles")
    split = join_salted(stars, many, ["hub", "hub_p"], "uses", ["rep", "p"], stars.count()).withColumn("part", F.expr("pmod(xxhash64(rep, p), parts)"))
    load = split.selectExpr("hub as star", "hub_p as star_p", "part", "rep", "p", "false as hub").union(
        split.selectExpr("hub as star", "hub_p as star_p", "part", "hub as rep", "hub_p as p", "true as hub").distinct()
    )
    links = frozen(with_sets(load, ["star", "star_p", "part"]).groupBy("star", "star_p", "part").applyInPandas(_verify_star(percent), "a long, b long"))
    comps = connected_components(links)

    rest = members.where("members > 2").select("bucket", "rep", "p", "n", "members", "shingles").join(
        comps.withColumnRenamed("node", "rep"), "rep", "left"
    ).withColumn("component", F.coalesce("component", "rep"))
    rest = frozen(rest)
    open_ = rest.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("rep", "component")).alias("hub"), F.count("*").alias("uses")
    ).where("lo < hi").selectExpr("bucket", "hub.component as hub", "uses")
    # The hub's component, mostly the largest, has chunks of its own: pairs of those need no look.
    cut = F.struct((F.col("component") == F.col("hub")).alias("core"), F.pmod(F.xxhash64("rep", "p"), _parts("members", "shingles", *chunk)).alias("part"))
    left = frozen(join_salted(rest, open_, ["bucket"], "uses", ["rep", "p"], rest.count()).withColumn("chunk", cut).select("bucket", "rep", "p", "component", "chunk"))
    drop_frozen(rest)
    chunks = left.groupBy("bucket", "chunk").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    cells = (
        chunks.alias("x").join(chunks.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.chunk") <= F.col("y.chunk")))
        .where("not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)")
        .selectExpr("x.bucket", "x.chunk as i", "y.chunk as j")
    )
    sides = cells.selectExpr("bucket", "i", "j", "i as chunk", "0 as side").union(
        cells.where("i <> j").selectExpr("bucket", "i", "j", "j as chunk", "1 as side")
    )
    load = left.join(sides, ["bucket", "chunk"]).select("bucket", "i", "j", "side", "rep", "p", "component")
    more = frozen(with_sets(load, ["bucket", "i", "j"]).groupBy("bucket", "i", "j").applyInPandas(_verify_cell(percent), "a long, b long"))
    comps = connected_components(links.union(more))
    for done in (members, sets, stars, left, links, more):
        drop_frozen(done)

    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"), "copies")
    linked = join_salted(whole.select("doc_id", *same), named, same, "copies", ["doc_id"], whole.count()).select("doc_id", "n_shingles", "component_id")
    alone = sigs.where("doc_id is null or n_shingles = 0").selectExpr("doc_id", "n_shingles", "doc_id as component_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the smallest of its group of near duplicates.

    near_duplicates() says what is linked. Rows without a doc_id all stay. Of rows that share a
    doc_id one stays: the one of smallest text (null first), then of smallest hash of its other
    columns, so reruns agree. Null, empty and wordless texts are linked with nothing and stay;
    columns may have any names; an empty table gives no rows.
    """
    kept = near_duplicates(docs, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("*").alias("tie"))
    # Equal ids are merged before the exchange, so an id that very many rows have is no hot key.
    one = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min_by("row", F.struct("text", "tie")).alias("row"))
    named = one.join(kept, one["doc_id"] == kept["kept_id"], "left_semi").select("row")
    return named.union(rows.where("doc_id is null").select("row")).select("row.*")
