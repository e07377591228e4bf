"""Stored tables: dated append tables and last-write-wins tables.

A table is a Parquet folder partitioned by its own columns, ``writer`` and
``batch_id``.  The writer is the id that a streaming query keeps in its
checkpoint, so a batch only ever replaces its own earlier try: a query with a
new checkpoint, or a second job that shares the folder, adds.  Nothing that is
being read is overwritten.  ``roll_up`` folds many small batches into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.operators.dedup import latest_record

WRITER, BATCH, WRITTEN = "writer", "batch_id", "written_at"
OWN = [T.StructField(WRITTEN, T.TimestampType()), T.StructField(WRITER, T.StringType()),
       T.StructField(BATCH, T.LongType())]


def writer_id(batch: DataFrame) -> str:
    """Id of the streaming query that runs this batch.

    It is stored in the query's checkpoint.  Outside of a stream every write is
    a writer of its own.
    """
    own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return own or uuid.uuid4().hex


def write_batch(
    batch: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = (),
    writer: str | None = None, key: str | None = None, order: Sequence[str] = (),
) -> None:
    """Write one batch, replacing an earlier try of the same writer and batch.

    The rebalance hint gives adaptive execution the say over file sizes: small
    batches become few files, a day that holds everything is still split.  With
    ``key`` all rows of one key go to one file instead, sorted by ``order``.
    """
    layout = [*partition_by, WRITER, BATCH]
    rows = batch.withColumns({
        WRITTEN: F.current_timestamp(),
        WRITER: F.lit(writer or writer_id(batch)),
        BATCH: F.lit(batch_id).cast("bigint"),
    })
    if key is None:
        rows = rows.hint("rebalance", *partition_by)
    else:  # sorted by the folders first, so that writing them needs no sort of its own
        rows = rows.repartition(*partition_by, key).sortWithinPartitions(*layout, key, *order)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*layout)
        .parquet(path)
    )


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """The rows of all batches.

    Dates in partition names come back as text, as they were written; filters
    on them still prune partitions.  With ``schema`` (the written columns) a
    table whose batches were all empty can be read too.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType(
            [*schema.fields, *OWN]
        ))
    table = reader.parquet(path)
    written = {f.name: f.dataType for f in schema} if schema is not None else {}
    for field in table.schema:
        if isinstance(field.dataType, T.DateType) and field.name not in written:
            table = table.withColumn(field.name, F.col(field.name).cast("string"))
    return table.withColumn(BATCH, F.col(BATCH).cast("bigint"))


def read_latest(
    spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = (),
    schema: T.StructType | None = None,
) -> DataFrame:
    """Last written row per key, over all batches of all writers.

    ``order`` comes first (a sequence of the feed), then the time of writing.
    With a partition column among the keys (the day of an order) a filter on
    it reaches the scan, so only its partitions are read.
    """
    rows = latest_record(read_table(spark, path, schema), keys, [*order, WRITTEN, BATCH])
    return rows.drop(WRITTEN, WRITER, BATCH)


def roll_up(
    spark: SparkSession, path: str, new_path: str, keys: Sequence[str] = (),
    order: Sequence[str] = (), partition_by: Sequence[str] = (),
) -> None:
    """Write a table anew as one batch, so that the number of folders does not
    grow with the number of batches.

    With ``keys`` only the current row of each key is kept, without them every
    row.  Rows keep the time they were written; the caller points readers and
    writers to the new folder.
    """
    rows = read_table(spark, path)
    if keys:
        rows = latest_record(rows, keys, [*order, WRITTEN, BATCH])
    (
        rows.withColumns({WRITER: F.lit("roll-up"), BATCH: F.lit(0).cast("bigint")})
        .hint("rebalance", *partition_by)
        .write.mode("errorifexists")
        .partitionBy(*partition_by, WRITER, BATCH)
        .parquet(new_path)
    )
