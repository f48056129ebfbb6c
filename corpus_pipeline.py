"""A training corpus from documents: toxic texts out, near copies out, repeats out, mixed, packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aislelens.llm.common import drop_frozen, frozen, table
from aislelens.llm.mixing import curriculum
from aislelens.llm.near_dedup import without_near_duplicates
from aislelens.llm.packing import pack_documents
from aislelens.llm.repeats import without_repeats
from aislelens.llm.tokens import vocabulary
from aislelens.llm.toxicity import drop_toxic

# All stages: columns beside those named may have any names, and those of documents are returned
# by all stages but the last; an empty table gives no rows; nulls in other columns are passed on.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5, unchanged.

    Null or empty texts score as the classifier's intercept and stay; repeated rows score
    alike; a very long text is scored as a whole.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more), the one of the smallest doc_id.

    Null, empty and wordless texts are linked with nothing; rows without a doc_id stay; of rows
    that share a doc_id the one of smallest text stays; a very long text is one large set.
    """
    return without_near_duplicates(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat earlier text; n_chars follows the text.

    A document left empty stays, a null text stays null; rows that share a doc_id count in
    stored order; a very long text is cut as a whole.
    """
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in the order of training.

    Null and empty texts have no words to take and are not part of it; a null source is the
    last one; repeated rows and ids each count; a cut copy has the first words of its text.
    """
    return curriculum(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens.

    A null or empty text is its end mark alone; copies are packed each; a very long text is cut
    into pieces.
    """
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A fitted classifier, suffix arrays and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again, and deleted once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = frozen(docs)
            if last is not None:
                drop_frozen(last)
            last = docs
    return docs
