"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of an enhanced suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, bounded_batches, drop_frozen, frozen, join_salted, numbered, passes, release, utf8

MIN_BYTES = 100
#: Length of the grams that anchor a window; the smaller, the more anchors agree by chance.
GRAM = 32
#: Bytes of one document handled at once; the next part starts MIN_BYTES - 1 bytes earlier.
PART = 1 << 22
#: Distinct contexts of one anchor that one suffix array is built of; beyond, an anchor's windows are counted by their bytes.
FAMILY = 4096


# ------------------------------------------------------------ enhanced suffix array
def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, alike): `starts` sorted by the `depth` bytes there (a sparse suffix array cut at
    `depth`; equal prefixes keep their order), and whether a suffix shares all of them with the
    one before. `depth` bytes have to follow every start."""
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, depth)[starts]).view(f"S{depth}").ravel()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return starts[order], np.concatenate([[False], keys[1:] == keys[:-1]])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    n = min(len(a), len(b))
    while known < n and a[known] == b[known]:
        known += 1
    return known


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of every node of at least `least` in the tree of common-prefix intervals.

    One stack scan: a value above the top opens a node, a smaller one closes all deeper nodes.
    """
    out, stack = [], [(0, 0)]
    for i, v in enumerate([*lcp[1:].tolist(), 0], 1):
        first = i - 1
        while v < stack[-1][0]:
            length, first = stack.pop()
            if length >= least:
                out.append((length, first, i - 1))
        if v > stack[-1][0]:
            stack.append((v, first))
    return out


def repeat_groups(suffixes: list[bytes], left: list[int], least: int, known: int = 0) -> list[tuple[int, list[int]]]:
    """(length, members) of the maximal repeats among `suffixes`, which share `known` bytes.

    left: the byte before each suffix, negative (and different for each) where there is none.
    A node of the common-prefix interval tree counts if its members' left bytes differ; if all
    are equal, the repeat one byte to the left has the same occurrences and tells it all.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    lcp = np.array([0, *(common_prefix(suffixes[a], suffixes[b], known) for a, b in zip(order, order[1:], strict=False))])
    out = []
    for length, first, last in lcp_intervals(lcp, least):
        members = order[first : last + 1]
        if len({left[m] for m in members}) > 1:
            out.append((length, sorted(members)))
    return out


def maximal_repeats(text: bytes, least: int) -> list[tuple[int, list[int]]]:
    """(length, all starts) of each string of at least `least` bytes that occurs again and can be
    extended neither to the left nor to the right without losing an occurrence."""
    return repeat_groups([text[i:] for i in range(len(text))], [text[i - 1] if i else -1 for i in range(len(text))], least)


# ------------------------------------------------------------ anchors
def anchors(data: np.ndarray, least: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, gram position, first window, last window) that cover all `least`-byte windows of one text.

    Each window is handed to its gram of smallest hash, the leftmost of equals; windows of
    equal bytes choose alike, so windows that repeat meet at equal hashes.
    """
    n = len(data) - least + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z
    at = np.arange(len(data) - gram + 1)
    h = SpanHash(data)(at, at + gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, low = least - gram + 1, key
    size = 1
    while size < width:
        step = min(size, width - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return h[at[first]], at[first], first, last


def _parts(data: np.ndarray, off: np.ndarray, least: int, part: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, base, bytes): each document in parts that share least - 1 bytes."""
    for r in range(len(off) - 1):
        text = data[off[r] : off[r + 1]]
        for base in range(0, max(1, len(text) - least + 1), part):
            yield r, base, text[base : base + part + least - 1]


def _anchor_rows(least: int, part: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            ids = batch.column("row_no").to_numpy()
            for i, j in passes(off):
                found = [(ids[i + r], base, *anchors(t, least)) for r, base, t in _parts(data, off[i : j + 1], least, part)]
                found = [x for x in found if len(x[2])]
                if found:
                    h, first, last, pos = (np.concatenate(x) for x in zip(*[(f[2], f[4] + f[1], f[5] + f[1], f[3] + f[1]) for f in found], strict=True))
                    row = np.repeat(np.array([f[0] for f in found]), [len(f[2]) for f in found])
                    spot = first << 16 | (last - first) << 8 | (pos - first)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(row), pa.array(spot)], ["h", "row_no", "spot"])

    return rows


def _contexts(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of all windows handed to an anchor that repeats."""
        for batch in batches:
            data, off = utf8(batch.column("text"))
            ids, row_no, spots = batch.column("doc_id").to_pylist(), batch.column("row_no").to_pylist(), batch.column("spots")
            for i, j in passes(off):
                out: dict[str, list] = {k: [] for k in ("h", "ctx", "bytes", "doc_id", "row_no", "spot")}
                for r in range(i, j):
                    v, text = spots[r].values, data[off[r] : off[r + 1]].tobytes()
                    spot = v.field("spot").to_pylist()
                    texts = [text[x >> 16 : (x >> 16) + (x >> 8 & 255) + least] for x in spot]
                    out["h"] += v.field("h").to_pylist()
                    out["ctx"] += [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts]
                    out["bytes"] += texts
                    out["doc_id"] += [ids[r]] * len(spot)
                    out["row_no"] += [row_no[r]] * len(spot)
                    out["spot"] += spot
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "bytes" else pa.int64()) for k, v in out.items()], list(out))

    return rows


def _families(least: int):
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Repeats among the contexts of whole anchors; what of each context's first place repeats earlier text."""
        pdf = pdf.sort_values(["doc_id", "row_no", "spot"], na_position="first", kind="stable", ignore_index=True)
        size = pdf["bytes"].str.len().to_numpy()
        joined = b"".join(pdf["bytes"])
        base = np.concatenate([[0], np.cumsum(size)])
        count = size - least + 1
        owner = np.repeat(np.arange(len(pdf)), count)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        spot = pdf["spot"].to_numpy()
        order, alike = suffix_array(np.frombuffer(joined, np.uint8), base[owner] + shift, least)
        holder = np.searchsorted(base, order, "right") - 1
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(pdf))]
        # Nodes of at least `least` bytes: runs of suffixes that are alike.
        head = np.flatnonzero(~alike)
        tail = np.concatenate([head[1:], [len(order)]])
        # The first window of a context has an unknown byte on its left, which may differ.
        left = np.where(order > base[holder], np.frombuffer(joined, np.uint8)[order - 1].astype(np.int64), -1 - holder)
        diverse = np.minimum.reduceat(left, head) != np.maximum.reduceat(left, head)
        for a, b in zip(head[diverse].tolist(), tail[diverse].tolist(), strict=True):
            at, who = order[a:b].tolist(), holder[a:b].tolist()
            for length, members in repeat_groups([joined[x : base[w + 1]] for x, w in zip(at, who, strict=True)], left[a:b].tolist(), least, least):
                first = min(members, key=who.__getitem__)
                for m in members:
                    if m != first:
                        x = at[m] - int(base[who[m]]) + int(spot[who[m]] >> 16)
                        out[who[m]].append((x, x + length))
        ends = [(r, a, b) for r, spans in enumerate(out) for a, b in _merged(spans)]
        rows = [r for r, _, _ in ends]
        return pd.DataFrame({"row_no": pdf["row_no"].to_numpy()[rows], "a": [e[1] for e in ends], "b": [e[2] for e in ends]}, dtype="int64")

    def whole_anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches are cut between anchors: rows come sorted by them."""
        kept: list[pd.DataFrame] = []
        rows = 0
        for pdf in frames:
            if not len(pdf):
                continue
            last = pdf["h"] == pdf["h"].iloc[-1]
            cut = int(np.flatnonzero(~last.to_numpy())[-1]) + 1 if not last.all() else 0
            same = kept and kept[-1]["h"].iloc[-1] == pdf["h"].iloc[-1]
            if cut == 0 and (not kept or same):
                kept.append(pdf)
                continue
            yield judge(pd.concat([*kept, pdf.iloc[:cut]]))
            kept = [pdf.iloc[cut:]]
        if kept:
            yield judge(pd.concat(kept))

    return whole_anchors


def _windows(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window of each context by itself."""
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("h", "bytes", "doc_id", "row_no", "spot")}
            for h, text, doc, row, spot in zip(*(batch.column(k).to_pylist() for k in ("h", "bytes", "doc_id", "row_no", "spot")), strict=True):
                n = len(text) - least + 1
                out["h"] += [h] * n
                out["bytes"] += [text[k : k + least] for k in range(n)]
                out["doc_id"] += [doc] * n
                out["row_no"] += [row] * n
                out["spot"] += [(spot >> 16) + k << 16 for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "bytes" else pa.int64()) for k, v in out.items()], list(out))

    return rows


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _hits(docs: DataFrame, least: int, part: int) -> DataFrame:
    """(row_no, spots): for each row its anchors that occur again."""
    spots = frozen(docs.select("row_no", "text").mapInArrow(_anchor_rows(least, part), "h long, row_no long, spot long"))
    again = spots.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = join_salted(spots, again, ["h"], "n", ["row_no", "spot"], spots.count())
    hits = frozen(found.groupBy("row_no").agg(F.collect_list(F.struct("h", "spot")).alias("spots")))
    drop_frozen(spots)
    return hits


def _places(docs: DataFrame, hits: DataFrame, least: int) -> DataFrame:
    """Every place of an anchor that occurs again, with the bytes of its windows."""
    found = docs.select("doc_id", "row_no", "text").join(hits, "row_no").mapInArrow(
        _contexts(least), "h long, ctx long, bytes binary, doc_id long, row_no long, spot long"
    )
    return frozen(found)


def _leaves(places: DataFrame) -> DataFrame:
    """Each different context of an anchor with its earliest place and the number of places."""
    leaves = places.groupBy("h", "ctx", "bytes").agg(F.min(F.struct("doc_id", "row_no", "spot")).alias("at"), F.count("*").alias("places"))
    return frozen(leaves.select("h", "ctx", "bytes", "at.*", "places"))


def _later_windows(leaves: DataFrame, wide: DataFrame, least: int) -> DataFrame:
    """(row_no, a, b): windows of the anchors `wide` (h, uses) that also start earlier.

    Such an anchor has too many contexts for one suffix array. Its windows are merged like
    contexts: equal ones to their least place by a pre-aggregated minimum, and each other
    place is joined with that one, in parts where a window has very many places.
    """
    found = join_salted(leaves.select("h", "bytes", "doc_id", "row_no", "spot"), wide, ["h"], "uses", ["row_no", "spot"])
    windows = frozen(found.mapInArrow(_windows(least), "h long, bytes binary, doc_id long, row_no long, spot long"))
    first = frozen(windows.groupBy("h", "bytes").agg(F.min(F.struct("doc_id", "row_no", "spot")).alias("at"), F.count("*").alias("places")).where("places > 1"))
    first = first.select("h", "bytes", F.col("at.row_no").alias("r0"), F.col("at.spot").alias("s0"), "places")
    late = join_salted(windows.select("h", "bytes", "row_no", "spot"), first, ["h", "bytes"], "places", ["row_no", "spot"])
    return late.where("row_no <> r0 or spot <> s0").selectExpr("row_no", "shiftright(spot, 16) as a", f"shiftright(spot, 16) + {least} as b")


def repeated_spans(docs: DataFrame, least: int = MIN_BYTES, most: int = FAMILY, part: int = PART) -> DataFrame:
    """(row_no, spans): for rows of docs (row_no, doc_id, text), the byte ranges that `least`-byte strings cover which also start earlier.

    Earlier: smaller doc_id (null first), then smaller row_no, then smaller start. row_no has
    to be stored with the rows, so that each scan sees the same one. Every window of `least`
    bytes belongs to one content-chosen anchor gram. Anchors seen once are done after one
    count; for the rest only the bytes around the anchor travel. Equal contexts are one leaf of
    the suffix array with its earliest place, found by a pre-aggregated minimum, so a passage
    that a third of all rows share is one leaf too. A suffix array holds the contexts of one
    anchor, `most` at most; the windows of an anchor with more are counted one by one
    (_later_windows), with the same result. Joins on anchors, contexts and windows split keys of very
    many rows.
    """
    bounded_batches(docs.sparkSession)
    hits = _hits(docs, least, part)
    release(docs.sparkSession)
    places = _places(docs, hits, least)
    drop_frozen(hits)
    release(docs.sparkSession)
    leaves = _leaves(places)
    release(docs.sparkSession)
    kin = frozen(leaves.groupBy("h").agg(F.count("*").alias("uses")).where("uses > 1"))
    family = leaves.select("h", "bytes", "doc_id", "row_no", "spot").join(kin.where(F.col("uses") <= most).select("h"), "h")
    late = family.repartition("h").sortWithinPartitions("h").mapInPandas(_families(least), "row_no long, a long, b long")
    wide = kin.where(F.col("uses") > most)
    if not wide.isEmpty():
        late = late.union(_later_windows(leaves, wide, least))
    first = leaves.where("places > 1").select("h", "ctx", F.col("row_no").alias("r0"), F.col("spot").alias("s0"), "places")
    copies = join_salted(places.select("h", "ctx", "row_no", "spot"), first, ["h", "ctx"], "places", ["row_no", "spot"], places.count())
    copies = copies.where("row_no <> r0 or spot <> s0").selectExpr("row_no", "shiftright(spot, 16) as a", f"shiftright(spot, 16) + (shiftright(spot, 8) & 255) + {least} as b")
    found = frozen(late.union(copies))
    drop_frozen(places)
    drop_frozen(leaves)
    drop_frozen(kin)
    del leaves, places, kin, family, wide, first, late, copies
    release(docs.sparkSession)
    return found.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column("text"))
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "clean")}
        spans = batch.column("spans")
        for r in range(batch.num_rows):
            text = data[off[r] : off[r + 1]]
            v = spans[r].values if spans[r].is_valid else None
            merged = _merged(list(zip(v.field("a").to_pylist(), v.field("b").to_pylist(), strict=True))) if v is not None else []
            kept, at = [], 0
            for a, b in merged:
                kept.append(text[at:a].tobytes())
                at = b
            rest = b"".join([*kept, text[at:].tobytes()])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(rest))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            out["clean"].append(rest.decode("utf-8", "ignore") if merged else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_no"), batch.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["clean"], pa.string())],
            ["row_no", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "clean"],
        )


def remove_repeats(docs: DataFrame, least: int = MIN_BYTES, most: int = FAMILY, part: int = PART) -> DataFrame:
    """(row_no, doc_id, n_bytes, n_removed, n_spans, kept_sha256, clean) for each row of docs (row_no, doc_id, text), row_no stored with it.

    Texts are UTF-8 bytes (null: empty); every byte that a `least`-byte string covers which
    also starts earlier goes, judged on the input. Matches never cross rows. clean: the
    remaining bytes as text, null where nothing went; halves of a character that a cut leaves
    are not part of it (kept_sha256 is over the bytes themselves). A null doc_id comes before
    all others; rows of one doc_id count in the order of row_no. Repeated rows repeat each
    other's text. A very long text is handled in parts of PART bytes that overlap, with the
    same result. Other columns are not looked at. No rows give no rows.
    """
    spans = repeated_spans(docs, least, most, part)
    cut = docs.select("row_no", "doc_id", "text").join(spans, "row_no", "left")
    return cut.mapInArrow(_cut, "row_no long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, clean string")


def deduplicate_documents(docs: DataFrame, least: int = MIN_BYTES, most: int = FAMILY, part: int = PART) -> DataFrame:
    """remove_repeats() of (doc_id, text), with a stored number for each row of the table."""
    rows = frozen(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))))
    return remove_repeats(rows, least, most, part)


def without_repeats(docs: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """docs with all its columns and rows, repeats taken out of text; n_chars, where there is one, follows the text.

    remove_repeats() says what goes. A text that is cut down to nothing stays as an empty one;
    a null text stays null. The row travels as one struct, so columns may have any names; it
    is stored once, and a scan reads those of its fields that it needs.
    """
    rows = frozen(docs.select(F.struct("*").alias("row")).withColumn("row_no", F.monotonically_increasing_id()))
    found = remove_repeats(rows.select("row_no", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text")), least)
    cut = frozen(found.where("n_removed > 0").select("row_no", "clean"))
    row, hit = F.col("row"), F.col("clean").isNotNull()
    row = row.withField("text", F.when(hit, F.col("clean")).otherwise(F.col("row.text").cast("string")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(hit, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return rows.select("row_no", "row").join(cut, "row_no", "left").select(row.alias("row")).select("row.*")
