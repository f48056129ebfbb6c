"""Content-addressed store of token ids: chunks cut by a rolling hash, recipes, a Merkle manifest."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_frozen, frozen, global_prefix_sums, join_salted, mix, new_folder, passes, utf8
from .tokens import encoder, with_end

END = 2
#: Ids that the rolling hash looks at, its cut condition (one in 2**CUT_BITS), and a chunk's limits.
WINDOW, CUT_BITS, LEAST, MOST = 16, 8, 64, 2048
#: Ids hashed at once.
ROLL = 1 << 14
#: Bytes of text encoded at once; a longer document is a pass of its own.
TEXT_BYTES = 16 << 20
#: Children of a node of the manifest.
FAN = 1024


def _wishes(ids: np.ndarray) -> np.ndarray:
    """Places behind which the hash of the last WINDOW ids says to cut; in blocks that stay in a CPU's cache."""
    out = [np.zeros(0, np.int64)]
    for lo in range(0, len(ids), ROLL):
        back = max(0, lo - WINDOW + 1)
        with np.errstate(over="ignore"):
            h = mix(ids[back : lo + ROLL].astype(np.uint64) + np.uint64(1))
            roll = np.zeros(len(h), np.uint64)
            for k in range(min(WINDOW, len(h))):
                roll[k:] += h[: len(h) - k] * np.uint64(2 * k * k + 6 * k + 3)
        out.append(np.flatnonzero(mix(roll[lo - back :]) >> np.uint64(64 - CUT_BITS) == 0) + lo + 1)
    return np.concatenate(out)


def cut_points(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document: where the hash of the last WINDOW ids says so, within the limits.

    `ids` are those of all documents, `ends` where each one ends. The hash is rolled over all of
    them at once: a cut is LEAST > WINDOW ids or more behind its document's start, so what it
    looks at is the document's own.
    """
    wish = _wishes(ids)
    inside = np.searchsorted(wish, ends)
    wish, out, at, w = wish.tolist(), [], 0, 0
    for end, last in zip(ends.tolist(), inside.tolist(), strict=True):
        cuts = []
        for x in [*wish[w:last], end]:
            while x - at > MOST:
                at += MOST
                cuts.append(at)
            if x - at >= LEAST or x == end and x > at:
                at = x
                cuts.append(at)
        w = last
        out.append(cuts)
    return out


def _chunks(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaced=False)
        kind, width = ("<u2", 2) if enc.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", 4)
        for batch in batches:
            _, off = utf8(batch.column("text"))
            for i, j in passes(off, TEXT_BYTES):
                ids, n = with_end(*enc.column(batch.column("text").slice(i, j - i)), END)
                ends = np.cumsum(n)
                row, at, size, key, digest = [], [], [], [], []
                short = np.ascontiguousarray(ids.astype(kind))
                raw = memoryview(short).cast("B")
                for r, (begin, cuts) in enumerate(zip((ends - n).tolist(), cut_points(ids, ends), strict=True)):
                    first, last = len(key), begin
                    for c in cuts:
                        row.append(r)
                        at.append(last - begin)
                        size.append(c - last)
                        key.append(hashlib.blake2b(raw[width * last : width * c], digest_size=16).digest())
                        last = c
                    told = ",".join(f"{k.hex()}:{m}" for k, m in zip(key[first:], size[first:], strict=True))
                    digest += [hashlib.sha256(told.encode()).hexdigest(), *[None] * (len(cuts) - 1)]
                # Chunks follow each other without gaps: the column's bytes are the ids themselves.
                edge = np.concatenate([[0], np.cumsum(size, dtype=np.int64) * width])
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(edge), pa.py_buffer(short)]).cast(pa.binary())
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, pa.binary()), batch.column("doc_id").slice(i, j - i).take(take), batch.column("row_no").slice(i, j - i).take(take),
                        pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(n[row], pa.int64()), pa.array(digest, pa.string()), data,
                    ],
                    ["key", "doc_id", "row_no", "at", "n", "total", "digest", "data"],
                )

    return rows


class Damaged(RuntimeError):
    """What is stored is not what was written."""


def write_store(docs: DataFrame, tokenizer: str, folder: str) -> None:
    """Writes docs (doc_id, text) to `folder`: chunks/, recipes/ and manifest/.

    chunks (key, width, uses, data): the ids of each different chunk once, little-endian,
    `width` bytes an id, named by the BLAKE2b digest of the bytes; uses: places of it.
    recipes (doc_id, row_no, at, n, total, key): a row for each chunk of a document, in
    ascending doc_id order. manifest (level, no, digest): a Merkle tree. Its leaves are the
    SHA-256 of each document's chunk names and lengths in order, taken while the ids are cut;
    a node of level 1 is the SHA-256 of FAN leaves that follow each other by (doc_id, row_no),
    and so on up to one root. Names are digests of bytes, so the root stands for all ids.

    One scan encodes, and one exchange by key brings equal chunks together: bytes move once.

    A null text is an empty one, which has the end id alone; a very long text is encoded as a
    pass of its own. Repeated rows are documents of their own that share all chunks; a null
    doc_id comes first. Other columns are not looked at, whatever their names. No rows give
    empty tables, whose root is the digest of the empty string.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 5000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_no", F.monotonically_increasing_id())
    made = frozen(rows.mapInArrow(_chunks(tokenizer), "key binary, doc_id long, row_no long, at long, n long, total long, digest string, data binary"))
    # A chunk's bytes come from its first place; equal places are one row before the exchange.
    made.groupBy("key").agg(F.first("data").alias("data"), F.first("n").alias("n"), F.count("*").alias("uses")).selectExpr(
        "key", "int(length(data) div n) as width", "uses", "data"
    ).sortWithinPartitions("key").write.option("compression", "zstd").parquet(f"{folder}/chunks")
    made.drop("data", "digest").repartitionByRange("doc_id", "row_no").sortWithinPartitions("doc_id", "row_no", "at").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    leaves = global_prefix_sums(made.where("at = 0").select("doc_id", "row_no", "digest"), ["doc_id", "row_no"], {"no": "1L"})
    _write_tree(leaves.select("no", "digest"), f"{folder}/manifest")
    drop_frozen(leaves)
    drop_frozen(made)


def _write_tree(leaves: DataFrame, folder: str) -> None:
    """Writes the nodes above leaves (no, digest): level by level, until there is one."""
    spark, level = leaves.sparkSession, 0
    while level == 0 or leaves.count() > 1:
        level += 1
        nodes = leaves.groupBy(F.expr(f"no div {FAN}").alias("no")).agg(F.array_sort(F.collect_list(F.struct("no", "digest"))).alias("x"))
        nodes = nodes.select(F.lit(level).alias("level"), "no", F.sha2(F.array_join(F.transform("x", lambda x: x["digest"]), ""), 256).alias("digest"))
        nodes.write.mode("append").parquet(folder)
        leaves = spark.read.parquet(folder).where(f"level = {level}")


def root(spark: SparkSession, folder: str) -> str:
    """Merkle root of a store: the digest of its one topmost node; of no documents, that of the empty string."""
    top = spark.read.parquet(f"{folder}/manifest").orderBy(F.desc("level")).first()
    return top["digest"] if top else hashlib.sha256(b"").hexdigest()


def verify(spark: SparkSession, folder: str) -> bool:
    """Whether each chunk's bytes have the digest that names them, no chunk is missing, and the recipes give the manifest."""
    try:
        stored_documents(spark, folder).count()
    except Damaged:
        return False
    return True


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, row_no, ids) of every stored document, put together from its chunks; a missing chunk is an error."""
    chunks = spark.read.parquet(f"{folder}/chunks").drop("uses")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        if pdf["data"].isna().any():
            raise Damaged("a chunk is missing")
        ids = np.concatenate([np.frombuffer(d, f"<u{int(w)}") for d, w in zip(pdf["data"], pdf["width"], strict=True)]).astype(np.int32)
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "row_no": pdf["row_no"].iloc[:1], "ids": [ids]})

    return spark.read.parquet(f"{folder}/recipes").join(chunks, "key", "left").groupBy("row_no").applyInPandas(join, "doc_id long, row_no long, ids array<int>")


# ------------------------------------------------------------ checksums of documents from their chunks
def _crc_shift_columns(n_bytes_power: int) -> np.ndarray:
    """Columns of the linear map that 2**k zero bytes are to a CRC-32 register."""
    columns = [zlib.crc32(b"\0", (1 << b) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(32)]
    columns = np.array(columns, np.uint32)
    for _ in range(n_bytes_power):
        columns = _apply(columns, columns)
    return columns


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint32)
    for b in range(32):
        out ^= np.where(x >> np.uint32(b) & np.uint32(1), columns[b], np.uint32(0)).astype(np.uint32)
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What the CRC-32 of A adds to that of A + B where B has `n_bytes` bytes: crc(A + B) = shift(crc(A)) ^ crc(B)."""
    out, columns = crc.astype(np.uint32), _crc_shift_columns(0)
    for k in range(int(n_bytes.max()).bit_length() if len(n_bytes) else 0):
        on = (n_bytes >> k & 1).astype(bool)
        out[on] = _apply(columns, out[on])
        columns = _apply(columns, columns)
    return out


def _chunk_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CRC-32 of each chunk's ids as 32-bit integers; null if the bytes are not those that its key names."""
    for b in batches:
        data = b.column("data").cast(pa.large_binary())
        _, offsets, buffer = data.buffers()
        edge = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
        held = np.frombuffer(buffer, np.uint8)[edge[0] : edge[-1]] if buffer is not None else np.zeros(0, np.uint8)
        raw, crc = memoryview(held), []
        wide = {w: memoryview(held.view(f"<u{w}").astype("<u4")).cast("B") for w in pc.unique(b.column("width")).to_pylist() if len(held) % w == 0}
        edge = (edge - edge[0]).tolist()
        for key, w, i, j in zip(b.column("key").to_pylist(), b.column("width").to_pylist(), edge, edge[1:], strict=False):
            if hashlib.blake2b(raw[i:j], digest_size=16).digest() != key or (j - i) % w:
                crc.append(None)
            elif w in wide and i % w == 0:
                crc.append(zlib.crc32(wide[w][i * 4 // w : j * 4 // w]))
            else:  # chunks of several widths in one batch
                crc.append(zlib.crc32(np.frombuffer(raw[i:j], f"<u{w}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("uses"), pa.array(crc, pa.int64())], ["key", "uses", "crc"])


def _in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, n, total, crc = (b.column(k).to_numpy() for k in ("at", "n", "total", "crc"))
        moved = shift_crc(crc, 4 * (total - at - n)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "row_no", "at", "n", "total", "key")), pa.array(moved)], ["doc_id", "row_no", "at", "n", "total", "key", "crc"])


def stored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, row_no, start, n_tokens, ids_crc32) of every document, from the files alone, verified.

    ids_crc32 is the CRC-32 of the document's ids as little-endian unsigned 32-bit integers. It
    is made of the CRCs of its chunks: each different chunk is read, held against its name and
    summed once, and a chunk's CRC moved over the bytes behind it counts by exclusive or, so
    bytes needn't be shuffled into documents again. Recipes give each document's leaf anew, and
    the tree over them has to be the manifest. A chunk of very many places is
    joined in parts.
    start: ids of all documents before, by (doc_id, row_no). Raises Damaged if a chunk is
    changed or missing, or a recipe row is changed, lost or added. Each row written, repeated
    ones and ones with null or empty texts too, is a row here; a store of no rows gives none.
    """
    crc = frozen(spark.read.parquet(f"{folder}/chunks").select("key", "width", "uses", "data").mapInArrow(_chunk_crc, "key binary, uses long, crc long"))
    recipes = spark.read.parquet(f"{folder}/recipes")
    bad = crc.where("crc is null").count()
    if bad:
        raise Damaged(f"{bad} chunks are not what their names say")
    placed = join_salted(recipes, crc, ["key"], "uses", ["row_no", "at"])
    docs = placed.mapInArrow(_in_place, "doc_id long, row_no long, at long, n long, total long, key binary, crc long").groupBy("doc_id", "row_no").agg(
        F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.array_sort(F.collect_list(F.struct("at", "n", "key"))).alias("recipe")
    )
    told = F.array_join(F.transform("recipe", lambda x: F.concat(F.lower(F.hex(x["key"])), F.lit(":"), x["n"].cast("string"))), ",")
    docs = docs.select("doc_id", "row_no", "n_tokens", "ids_crc32", F.sha2(told, 256).alias("digest"))
    docs = global_prefix_sums(docs, ["doc_id", "row_no"], {"start": "n_tokens", "no": "1L"})
    again = new_folder(spark, "tree")
    _write_tree(docs.select("no", "digest"), again)
    now, then = spark.read.parquet(again), spark.read.parquet(f"{folder}/manifest")
    now._folder = again
    same = now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty()
    drop_frozen(now)
    drop_frozen(crc)
    if not same:
        raise Damaged("chunks and recipes do not give the manifest")
    return docs.select("doc_id", "row_no", "start", "n_tokens", "ids_crc32")
