"""Mixing sources to target weights along a curriculum, with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen, global_prefix_sums, numbered

#: Weights by a source's place in code point order, repeated.
WEIGHTS = (5, 2, 1)
#: Tokens of the mix as a share of all tokens, and the most often that a token is taken.
SHARE, REPEATS = 1.5, 2
#: A source's weight runs over training from TREND[k][0] to TREND[k][1] times its mean.
TREND = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def word_count(text: Column) -> Column:
    """Maximal runs without 0x20 and 0x09-0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(docs: DataFrame) -> DataFrame:
    """(source, source_size, target, trend) from docs (source, size): SHARE of all tokens by weight, none above REPEATS times its size.

    The excess of a capped source goes to the others by weight until none is above: the level
    at which min(cap, weight * level) adds up to the demand, found in the sources' order by
    cap / weight. Ranks of sources come from range partitions and their counts, not from one
    sorted task. Null is the last source.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranged = frozen(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range_no", F.spark_partition_id()))
    before = ranged.groupBy("range_no").agg(F.count("*").alias("n")).selectExpr(
        "range_no", "coalesce(sum(n) over (order by range_no rows between unbounded preceding and 1 preceding), 0) as base"
    )
    ranked = ranged.join(before, "range_no").selectExpr(
        "source", "source_size", "base + row_number() over (partition by range_no order by source nulls last) - 1 as place"
    )
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int"))
    weighed = frozen(
        ranked.withColumn("weight", pick([float(w) for w in WEIGHTS]))
        .withColumn("cap", (F.col("source_size") * REPEATS).cast("double"))
        .withColumn("slope", F.col("cap") / F.col("weight"))
    )
    # The level is between two slopes; what caps and weights below each slope add up to tells which.
    # Sums run over ranges of slopes first, so no task sees all sources.
    steps = weighed.groupBy("slope").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"))
    steps = global_prefix_sums(steps, ["slope"], {"below": "cap", "lighter": "weight"})
    everything = weighed.agg(F.sum("weight").alias("all_weight"))
    steps = steps.crossJoin(F.broadcast(everything)).selectExpr("slope", "below + cap as full", "all_weight - lighter - weight as open")
    demand = weighed.agg((F.sum("source_size") * F.lit(SHARE)).alias("demand"))
    # The least slope s with sum(min(cap, weight * s)) >= demand bounds the level from above.
    level = steps.crossJoin(F.broadcast(demand)).where("full + open * slope >= demand").agg(F.min("slope").alias("upper"))
    known = weighed.crossJoin(F.broadcast(level)).crossJoin(F.broadcast(demand))
    level = known.agg(
        F.max("demand").alias("demand"),
        F.sum(F.when(F.col("slope") < F.col("upper"), F.col("cap")).otherwise(0.0)).alias("full"),
        F.sum(F.when(F.col("slope") >= F.col("upper"), F.col("weight")).otherwise(0.0)).alias("open"),
    ).selectExpr("(demand - full) / open as level")
    return weighed.crossJoin(F.broadcast(level)).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.lit(0.0)).alias("target"),
        F.when(F.col("place") % 3 == 0, F.lit(0)).otherwise(F.when(F.col("place") % 3 == 1, 1).otherwise(2)).alias("trend"),
    )


def schedule(rows: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """rows (row_no, source, size, order_key, ...) with copy, taken, position, source_size and target: each copy that the mix takes.

    A source's documents follow each other in the order of order_key, ties by row_no, again and
    again, until its target is used up; the last one is cut there. A source's demand up to time
    t in [0, 1] is the integral of its weight, target * (a * t + (b - a) * t * t / 2); position
    is the time at which demand reaches the place where the copy starts, the integral inverted.
    Offsets are sums over (source, part) and then within a part, so that no source meets in one
    task; what is known of a source comes with the sums of its parts. Other columns of rows are
    passed on: they move once, to their part, where they meet its sums and are numbered.
    """
    targets = frozen(source_targets(rows)) if targets is None else targets
    # Plain keys for a null source: a null-safe join would hash other expressions than the window, and each row would move twice.
    rows = rows.withColumns({"part": F.substring("order_key", 1, 3), "named": F.coalesce("source", F.lit("")), "nameless": F.col("source").isNull()})
    keys = ["named", "nameless", "part"]
    parts = rows.groupBy(*keys).agg(F.sum("size").alias("n"))
    before = parts.selectExpr(
        *keys, "coalesce(sum(n) over (partition by named, nameless order by part rows between unbounded preceding and 1 preceding), 0) as base"
    )
    targets = targets.withColumns({"named": F.coalesce("source", F.lit("")), "nameless": F.col("source").isNull()}).drop("source")
    placed = rows.join(before.join(targets, keys[:2]), keys)
    placed = placed.withColumn(
        "begin", F.expr("base + coalesce(sum(size) over (partition by named, nameless, part order by order_key, row_no rows between unbounded preceding and 1 preceding), 0)")
    )
    copies = placed.withColumn("copy", F.explode(F.array(*map(F.lit, range(REPEATS)))))
    copies = copies.withColumn("start", F.col("begin") + F.col("copy") * F.col("source_size")).withColumn(
        "taken", F.greatest(F.lit(0), F.least("size", F.round("target").cast("long") - F.col("start"))).cast("long")
    )
    share = F.least(F.lit(1.0), F.col("start") / F.col("target"))
    a, b = (F.element_at(F.array(*(F.lit(t[k]) for t in TREND)), F.col("trend") + 1) for k in (0, 1))
    half = (b - a) / 2
    time = F.when(half == 0, share / a).otherwise((F.sqrt(a * a + 4 * half * share) - a) / (2 * half))
    return copies.withColumn("position", F.when(F.col("target") > 0, time).otherwise(1.0)).drop(*keys, "base", "begin", "start", "trend")


def in_order(copies: DataFrame) -> DataFrame:
    """Copies range-sorted by training position."""
    return copies.repartitionByRange("position", "row_no", "copy").sortWithinPartitions("position", "row_no", "copy")


def training_plan(rows: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(row_no, copy, taken, position) of the copies that the mix takes, written in the order of training."""
    return frozen(in_order(schedule(rows, targets).where("taken > 0").select("row_no", "copy", "taken", "position")))


def _order_key(doc_id: str) -> Column:
    """A digest of doc_id that every engine gives alike (null: of the empty string)."""
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def prepared(docs: DataFrame) -> DataFrame:
    """docs with row_no, size, and order_key."""
    return numbered(docs).withColumn("size", word_count(F.col("text"))).withColumn("order_key", _order_key("doc_id"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source).

    size: words; target: its source's; taken: words of it that the mix takes, all copies
    counted, at most REPEATS * size; summed over the written plan of copies and positions. A source's taken words add up to its target, rounded.
    Null text: size 0; a null source is a source, the last one; repeated rows each count; an
    empty table gives no rows. Other columns are not looked at. Ties of order_key (equal
    doc_ids) go by row number.
    """
    rows = prepared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")))
    rows = frozen(rows.select("row_no", "doc_id", "source", "size", "order_key"))
    targets = frozen(source_targets(rows))
    taken = training_plan(rows, targets).groupBy("row_no").agg(F.sum("taken").alias("taken"))
    named = rows.join(targets.withColumnRenamed("source", "s"), rows.source.eqNullSafe(F.col("s"))).join(taken, "row_no", "left")
    return named.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def curriculum(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, a row for each copy, range-sorted by training position.

    Columns are those of docs, whatever their names: the row travels as one struct. A copy that
    the mix cuts has the first words of its text, with the white space between them; n_chars,
    where there is one, is that of the text then. A document without words (null or empty
    text) has nothing to take and isn't part of the mix; repeated rows each count; an empty
    table gives no rows.
    """
    row, text = F.struct("*").alias("row"), F.col("text").cast("string")
    rows = docs.select(
        row, F.col("source").cast("string").alias("source"), word_count(text).alias("size"), _order_key("doc_id").alias("order_key"), F.xxhash64("doc_id", text).alias("row_no")
    )
    # Rows are scanned for sizes, for sums of parts and for texts; each time a row has the same key and tie, a hash of what it holds.
    got = schedule(rows, frozen(source_targets(rows.select("source", "size")))).where("taken > 0")
    text = F.col("row.text").cast("string")
    words = F.split(text, "(?<=[^ \\t\\n\\x0b\\f\\r])(?=[ \\t\\n\\x0b\\f\\r])")
    short = F.array_join(F.slice(words, 1, F.col("taken").cast("int")), "")
    cut = F.col("taken") < F.col("size")
    row = F.col("row").withField("text", F.when(cut, short).otherwise(text))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(cut, F.length(short).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return in_order(got.select(row.alias("row"), "position", "row_no", "copy")).select("row.*")
