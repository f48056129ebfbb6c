"""What the corpus operators share: tables, checkpoints, UTF-8 buffers and 64-bit hashing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
BLOCK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, set as the checkpoint folder too.

    ``spark.checkpoint.dir`` names it. Where that is unset, a master on one machine (tests)
    gets a new temporary folder; on a cluster it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            known = known.get()
        elif spark.sparkContext.master.startswith("local"):
            known = f"file://{tempfile.mkdtemp(prefix='ckpt')}"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(known)
    return known


def frozen(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet (zstd) and read back: lineage is cut, lost executors are harmless."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "part")
    df.write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def drop_frozen(df: DataFrame) -> None:
    """Deletes what frozen() wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more: it notices when the driver collects garbage."""
    for _ in range(2):  # the first round frees what the second one's garbage was held by
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Adds a long that is unique per input row and the same whenever a scan task is retried."""
    return df.withColumn(name, F.monotonically_increasing_id())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text. No copy of the bytes."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def passes(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---------------------------------------------------------------- hashing
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


class SpanHash:
    """64-bit hash of any byte span of a buffer after one pass over it (polynomial prefix sums)."""

    def __init__(self, data: np.ndarray):
        p, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row): maximal runs without 0x20, 0x09-0x0D, never across rows.

    `off` counts from the start of `data`.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | cut[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z in lower case, and the first word of each row."""
    start, end, first = words(data, off)
    return SpanHash(_LOWER[data])(start, end) if len(start) else np.zeros(0, np.uint64), first


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def global_prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, for each out: value of `sums`, the sum of `value` over all rows before a row in ascending `order` (a total order).

    Range partitions are summed one by one, and only their totals (one row a partition) meet
    in one task; no window spans the table. The range partitioning is written out because
    partition numbers have to stay as they are. Its folder is the result's `_folder`.
    """
    part = frozen(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()))
    totals = part.groupBy("range_no").agg(*(F.sum(F.expr(v)).alias(out) for out, v in sums.items()))
    before = totals.selectExpr(
        "range_no", *(f"coalesce(sum({out}) over (order by range_no rows between unbounded preceding and 1 preceding), 0) as base_{out}" for out in sums)
    )
    window = f"(partition by range_no order by {', '.join(order)} rows between unbounded preceding and 1 preceding)"
    got = part.join(before, "range_no").select(*df.columns, *(F.expr(f"base_{out} + coalesce(sum({v}) over {window}, 0)").alias(out) for out, v in sums.items()))
    got._folder = part._folder
    return got


#: A key that holds more than one in HEAVY of all rows is heavy, so there are fewer than HEAVY of them: what is broadcast for them is bounded.
HEAVY = 1000


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], uses: str, salt: list[str], total: int | None = None) -> DataFrame:
    """left inner join right on `keys`, where the rows of no key have to meet in one task.

    right has a row for each key at most; its column `uses` (dropped) is how many rows of left
    have the key, or more. total: their sum, counted if not given. Heavy keys, fewer than
    HEAVY, are broadcast with a number of parts in proportion to their uses: rows of left go to
    a part by a hash of the columns `salt`, the row of right goes to each part.
    """
    total = (right.agg(F.sum(uses)).first()[0] or 0) if total is None else total
    heavy = F.broadcast(right.where(F.col(uses) * HEAVY > total).select(*keys, F.ceil(F.col(uses) * HEAVY / F.lit(max(1, total))).alias("salt_parts")))
    parts = F.coalesce("salt_parts", F.lit(1))
    one = left.join(heavy, keys, "left").withColumn("salt_no", F.pmod(F.xxhash64(*salt), parts)).drop("salt_parts")
    each = right.drop(uses).join(heavy, keys, "left").withColumn("salt_no", F.explode(F.sequence(F.lit(0), parts - 1).cast("array<long>"))).drop("salt_parts")
    return one.join(each, [*keys, "salt_no"]).drop("salt_no")


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets Arrow batches between the JVM and Python have at most `rows` rows, so that batches of long texts stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
