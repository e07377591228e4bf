"""Counts and amounts per day and hour, kept up with the detail rows.

Each batch adds its own sums to a small keyed table, one row per day and hour,
so a dashboard reads that and never the detail.  A batch that is run again after
its sums were taken adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.operators.orders import EXACT, exact_amount, rounded
from tillstream.sources.keyed import KeyedTable
from tillstream.sources.tables import writer_id

HOURS = T.StructType([
    T.StructField("day", T.StringType()), T.StructField("hour", T.StringType()),
    T.StructField("records", T.LongType()), T.StructField("amount", T.DecimalType(38, 10)),
])


def hour_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, HOURS, ("day", "hour"), buckets=4)


def with_hours(write, path: str, day: str, hour: str, amount: str | None = None):
    """A batch writer that also keeps the hours of its rows under ``path``.

    ``amount`` is added exactly; rows without a number in it count as records.
    The detail is written first and is replaced by a retry, the sums are taken
    once by batch number: whatever happens between the two, both are whole after
    the retry.
    """

    def write_both(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write(batch, batch_id)
            if batch.isEmpty():
                return
            value = exact_amount(amount) if amount else F.lit(None).cast(EXACT)
            rows = batch.select(
                F.col(day).cast("string").alias("day"), F.col(hour).cast("string").alias("hour"),
                F.lit(1).cast("bigint").alias("records"), value.alias("amount"))
            hour_table(batch.sparkSession, path).add(rows, writer_id(batch), batch_id)
        finally:
            batch.unpersist()

    return write_both


def read_hours(spark: SparkSession, path: str) -> DataFrame:
    """``day, hour, records, amount``; the amount rounded once, to the sixth decimal."""
    return hour_table(spark, path).current().withColumn("amount", rounded(F.col("amount")))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """``day, records, amount`` from the hours."""
    return hour_table(spark, path).current().groupBy("day").agg(
        F.sum("records").alias("records"), rounded(F.try_sum("amount")).alias("amount"))
