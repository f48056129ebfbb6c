"""Best-fit packing by minimum bin slack, planned on the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_frozen, frozen, passes, utf8
from .tokens import encoder, with_end

ROOM = 1024
END = 2
#: Bytes of text encoded at once; a longer document is a pass of its own.
TEXT_BYTES = 8 << 20
#: Parts of one length whose pieces are numbered in one task each.
PARTS = 4096


def plan(count: dict[int, int], room: int = ROOM) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, {length: pieces in a bin}) that use up `count` pieces of each length.

    Minimum bin slack with a fixed seed: a bin starts with the largest piece left, a bitset
    dynamic programme over the lengths left finds the fullest sum that fits beside it, and the
    combination is taken out as often as its lengths last. Each step uses up a length or
    brings it below what one bin takes, so steps depend on the number of lengths alone.
    """
    left = {n: c for n, c in sorted(count.items(), reverse=True) if c > 0}
    out = []
    while left:
        seed = next(iter(left))
        have = dict(left)
        have[seed] -= 1
        space = room - seed
        # reach[k]: bitset of sums of the first k (length, copies) items, copies as powers of two.
        items, reach, full = [], [1], (1 << (space + 1)) - 1
        for n, c in have.items():
            if n > space:
                continue
            c, step = min(c, space // n), 1
            while c > 0:
                take = min(step, c)
                items.append((n, take))
                reach.append((reach[-1] | reach[-1] << (n * take)) & full)
                c, step = c - take, step * 2
                if reach[-1] >> space:
                    break
            if reach[-1] >> space:
                break
        best = reach[-1].bit_length() - 1
        used = {seed: 1}
        for k in range(len(items), 0, -1):
            n, take = items[k - 1]
            if not reach[k - 1] >> best & 1:
                used[n] = used.get(n, 0) + take
                best -= n * take
        bins = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
        out.append((bins, used))
    return out


def _pieces(path: str, room: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaced=True)
        for batch in batches:
            _, off = utf8(batch.column("text"))
            for i, j in passes(off, TEXT_BYTES):
                ids, n = with_end(*enc.column(batch.column("text").slice(i, j - i)), END)
                ids, ends = np.ascontiguousarray(ids.astype("<u4")), np.cumsum(n)
                number = -(-n // room)
                row = np.repeat(np.arange(j - i), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                # Only the first piece may be shorter.
                short = n[row] - (number[row] - 1) * room
                start = np.where(piece == 0, 0, short + (piece - 1) * room)
                length = np.where(piece == 0, short, room)
                at = (ends - n)[row] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows


def pack_documents(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): pieces of docs (doc_id, text) in sequences of at most `room` tokens.

    A document is its ids and END; one longer than `room` is cut into pieces of `room`, the
    first one shorter if need be. Only counts by length (at most `room` numbers) come to the
    driver, where plan() sets up patterns of bins. The n-th piece of a length takes the n-th
    place that the patterns have for it: numbering goes by (length, part) with the parts'
    counts summed up, so no length meets in one task, and places are broadcast as intervals,
    whose number depends on `room` alone. Sequences of a single full piece need no pattern.

    Null or empty text: END alone. A null doc_id and repeated rows are packed as any other row.
    An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = frozen(
        docs.mapInArrow(_pieces(tokenizer, room), "doc_id long, piece long, start long, length long, ids_crc32 long")
        .withColumn("tie", F.monotonically_increasing_id())
        .withColumn("part", F.pmod(F.xxhash64("tie"), F.lit(PARTS)))
    )
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = parts.selectExpr(
        "length", "part", "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as base"
    )
    before = frozen(before)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, sequence = [], 0
    taken = dict.fromkeys(counts, 0)
    for bins, used in plan(counts, room):
        offset = 0
        for n, k in used.items():
            slots.append((n, taken[n], taken[n] + bins * k, k, sequence, offset))
            taken[n] += bins * k
            offset += n * k
        sequence += bins
    places = spark.createDataFrame(slots, "length long, lo long, hi long, each long, first long, at long")
    # Each length's places as one array, searched by rank: no join on a hot length.
    places = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "each", "first", "at"))).alias("places"))
    ranked = pieces.join(before, ["length", "part"]).withColumn(
        "rank", F.expr("base + row_number() over (partition by length, part order by tie) - 1")
    )
    return (
        ranked.join(F.broadcast(places), "length")
        .withColumn("p", F.expr("filter(places, x -> x.lo <= rank and rank < x.hi)[0]"))
        .selectExpr(
            "doc_id", "piece", "start", "length", "ids_crc32",
            "p.first + (rank - p.lo) div p.each as sequence_id", "p.at + (rank - p.lo) % p.each * length as offset",
        )
    )
