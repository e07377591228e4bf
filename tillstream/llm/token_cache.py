"""Token counts through a digest cache.

Every text is named by the sha256 of its content and every tokenizer by the
sha256 of its file.  Documents are joined to stored counts on both digests;
only distinct texts without a stored count are encoded, and their counts are
appended to the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm import tokens
from tillstream.llm.common import whole_text

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest (writers that
    ran at the same time may both have stored a text; their counts agree)."""
    return (
        spark.read.schema(CACHE_SCHEMA).parquet(path)
        .where(F.col("tokenizer") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )


def create_cache(spark: SparkSession, path: str) -> None:
    """Make an empty cache where there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(path)


def encode_counts(texts: DataFrame, tokenizer_path: str, spaces_kept: bool) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path, spaces_kept, counts_only=True)
        for batch in batches:
            found = batch.column(1).to_pylist()
            counts = [n for a, b in tokens.slices(found) for n in encoder.each(found[a:b])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )

    return texts.select("digest", "text").mapInArrow(count, "digest binary, n_tokens bigint")


def add_misses(docs: DataFrame, cache_path: str, tokenizer_path: str, spaces_kept: bool) -> None:
    """Append counts of all distinct texts of (row_id, text) that have none.

    One row stands for the copies of a text: the digests alone are reduced
    (inside the tasks first, so thousands of copies cost a row each task), and
    texts move once, on the key of the row that stands for them.
    """
    spark, version = docs.sparkSession, tokens.file_digest(tokenizer_path)
    digest = F.unhex(F.sha2(F.col("text"), 256))
    chosen = (
        docs.select("row_id", digest.alias("digest"))
        .groupBy("digest").agg(F.min("row_id").alias("row_id"))
        .join(read_cache(spark, cache_path, version), "digest", "left_anti")
        .withColumnsRenamed({"digest": "d", "row_id": "r"})
    )
    misses = docs.withColumn("digest", digest).join(
        chosen, F.col("row_id").eqNullSafe(F.col("r")) & (F.col("digest") == F.col("d")), "left_semi"
    )
    (
        encode_counts(misses, tokenizer_path, spaces_kept)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        .select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
        .write.mode("append").parquet(cache_path)
    )


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str,
                 spaces_kept: bool = True, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """Per row of ``docs`` (only id and text are read): id, n_bytes, n_tokens.

    Null texts count as empty and have 0 tokens; repeated rows stay rows;
    several texts under one id are counted one by one; an empty table gives no
    rows.  The encoding is the library's: no normalising beyond the tokenizer's
    own, no begin or end tokens, special strings in a text read as special.
    """
    create_cache(docs.sparkSession, cache_path)
    plain = docs.select(F.col(id_column).alias("row_id"), whole_text(text_column).alias("text"))
    add_misses(plain, cache_path, tokenizer_path, spaces_kept)
    counts = read_cache(docs.sparkSession, cache_path, tokens.file_digest(tokenizer_path))
    keyed = plain.select(
        "row_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    return keyed.join(counts, "digest", "left").select(
        F.col("row_id").alias(id_column), "n_bytes", "n_tokens"
    )
