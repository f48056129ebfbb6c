"""Spelling variants: words one edit apart by an errata trie, and the frequent form that each goes back to."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, bounded_batches, frozen, join_salted, signed

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Marks the end of a word among the characters after a prefix, and the replaced character of a merged subtree.
END, HOLE = 0, "\0"


def document_words(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, drop_one_in: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of docs (doc_id, text) with A-Z in lower case, of `least` code points or more, that occur `count` times or more.

    drop_one_in: where that number divides the CRC-32 h of `<doc_id>:<run>`, the run loses its
    code point h % length, as if mistyped. A null text has no words, a null doc_id is the empty
    one, repeated rows count each, other columns may have any names.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("who"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"([A-Za-zÀ-ÿ]{{{least},}})"), 1)).alias("run"))
    words = runs.select("who", F.translate("run", _UPPER, _UPPER.lower()).alias("word"))
    if drop_one_in:
        h = words.withColumn("h", F.crc32(F.concat("who", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        words = h.select(F.when(F.col("h") % drop_one_in == 0, F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, where each begins and the last ends)."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word's way down the trie: for each of its prefixes, named by a hash, the character after it."""
    for batch in batches:
        points, off = _points(batch.column("word").to_pylist())
        size = np.diff(off) + 1
        begin = np.repeat(off[:-1], size)
        depth = np.arange(len(begin)) - np.repeat(np.cumsum(size) - size, size)
        node = SpanHash(points)(begin, begin + depth)
        after = np.append(points, 0)[begin + depth].astype(np.int32)
        after[np.cumsum(size) - 1] = END
        numbers = np.repeat(np.asarray(batch.column("word_no")), size)
        for k in range(0, len(node), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[part]), pa.array(depth[part].astype(np.int32)), pa.array(signed(node[part])), pa.array(after[part])], ["word_no", "depth", "node", "after"])


def _errata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a word is where its light subtrees are merged into their heavy sibling's: with the first character skipped, replaced, or put behind the heavy one."""
    names = ["text", "hole", "word", "n"]
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        size = 0
        for word, n, edges in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "edges")), strict=True):
            for e in edges:
                head, tail, heavy = word[: e["depth"]], word[e["depth"] :], chr(e["heavy"])
                made = {head + heavy + tail: False}
                if tail:
                    made |= {head + tail[1:]: False, head + heavy + tail[1:]: False, head + HOLE + tail[1:]: True}
                for text, hole in made.items():
                    for v, x in zip(out, (text, hole, word, n), strict=True):
                        v.append(x)
                    size += len(text) + len(word)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names)
                out, size = ([], [], [], []), 0
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)], names)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of different words of words (word, n; one row a word) that differ by one inserted, deleted or replaced code point.

    The trie of all words is cut into heavy paths: at a prefix the heavy child is the character
    that most words go on with, all others are light, and a word has a logarithmic number of
    light edges. At each of them the light subtree is merged, small into large, three times:
    with its first character replaced by the heavy one or skipped, and with the heavy one put
    before it (a skip in the heavy subtree); light siblings meet with the character replaced by
    a mark. Terminals that coincide are words one edit apart. They are found by equality of
    whole strings, so a clash of prefix hashes costs work but neither adds nor loses a pair.

    Prefixes that go on in one way only have no light edge and are left out before the join.
    Characters that follow a prefix are counted before they are exchanged, and prefixes with
    very many words are joined in parts. Words that share a marked string differ in one
    character, so the alphabet bounds their number. A very long word has a row of fixed size
    for each prefix, and a text for each light edge only.
    """
    spark = words.sparkSession
    bounded_batches(spark)
    words = frozen(words.select("word", "n").withColumn("word_no", F.monotonically_increasing_id()))
    steps = words.select("word_no", "word").mapInArrow(_nodes, "word_no long, depth int, node long, after int")
    ways = steps.groupBy("node", "after").agg(F.count("*").alias("n"))
    heavy = ways.groupBy("node").agg(F.max_by(F.when(F.col("after") != END, F.col("after")), F.when(F.col("after") != END, F.struct("n", -F.col("after")))).alias("heavy"), F.count("*").alias("ways"), F.sum("n").alias("uses"))
    heavy = frozen(heavy.where("ways > 1").drop("ways"))
    light = join_salted(steps, heavy, ["node"], "uses", ["word_no"]).where("after <> heavy")
    edges = light.groupBy("word_no").agg(F.collect_list(F.struct("depth", "heavy")).alias("edges"))
    errata = frozen(words.join(edges, "word_no").select("word", "n", "edges").mapInArrow(_errata, "text string, hole boolean, word string, n long"))
    found = errata.where("not hole").join(words.select(F.col("word").alias("text"), F.col("n").alias("near_n")), "text").select("word", "n", F.col("text").alias("near"), "near_n")
    merged = errata.where("hole").groupBy("text").agg(F.collect_list(F.struct("word", "n")).alias("x")).where("size(x) > 1")
    sides = merged.select("x", F.explode("x").alias("a")).select("a", F.explode("x").alias("b")).where("a.word <> b.word").select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))
    turned = found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.union(turned).union(sides).distinct()


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; one row a word).

    form: the near word of largest n (ties: the first in code-point order) if that is `ratio`
    times the word's n or more, else null. root: where forms lead to in the end. Counts grow by
    `ratio` at each form, so the longest way is logarithmic and is halved in each round. An
    empty table gives no rows.
    """
    words = frozen(words.select("word", "n"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near").alias("near"))).alias("x"))
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("x.near").alias("form"), (-F.col("x.col1")).alias("form_n"))
    is_form = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    known = frozen(known.withColumn("form_n", F.when(is_form, F.col("form_n"))).withColumn("form", F.when(is_form, F.col("form"))))
    most = known.agg(F.max("form_n")).first()[0]
    ways = known.where("form is not null").select("word", F.col("form").alias("root"))
    steps = 1 + int(math.log(most, max(2, ratio))) if most else 0
    for _ in range(steps.bit_length()):
        ways = frozen(ways)
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return known.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
