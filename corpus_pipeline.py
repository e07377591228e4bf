"""From raw documents to packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm import decontamination, jaccard_join, quality, queries, suffix_dedup
from tillstream.llm.common import as_row, quoted, remainder, row_columns, stored, table


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality ranking rejects go."""
    return quality.keep_good(
        docs, table(spark, sf_dir, "labels"), training=remainder("doc_id", 5) != 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near duplicates stays."""
    return jaccard_join.keep_first(docs)


# A passage of 51 words has 316 bytes in the median and 235 or more in 99 of 100
# cases, so a repeat of more than 50 words has this many (see README).
REPEAT_BYTES = 240


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: repeated strings of 240 bytes are cut out of the texts; a
    character that the cut splits goes too, and n_chars follows.

    Every row stays, a copy of a long text with an empty one.  A null text comes
    out empty, a text under 240 bytes as it was; columns may have any names and
    hold nulls, and an empty table gives no rows.
    """
    # The text comes back cut, so the row that is carried leaves it out.
    others = [quoted(c) for c in docs.columns if c != "text"] or ["text"]
    cut = suffix_dedup.remove_repeats(
        docs.select(as_row(docs.select(others)).alias("doc"), "text"), ["doc"],
        window=REPEAT_BYTES, as_text=True)
    return cut.select(*row_columns(
        docs, "doc", text=F.col("kept"), n_chars=F.char_length("kept").cast("long")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents with a window of a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: what is left, in sequences of 4096 tokens."""
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# The stages use trained models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
