"""Keyed tables over the benchmark tables: upserts, compaction, lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.functions import times
from tillstream.operators import sales
from tillstream.plans import batch, inputs
from tillstream.session import checkpoint_root, remove_at_exit
from tillstream.sources.keyed import KeyedTable

# Deliveries of the activity log and of the users.
CUTS = ("2024-01-09", "2024-01-16", "2024-01-24")


def _new_table(spark: SparkSession, name: str, **settings) -> KeyedTable:
    place = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, place)
    return KeyedTable(spark, place, **settings)


def _slots(rows: DataFrame, time: str, cuts: tuple[str, ...]) -> list[DataFrame]:
    at = F.col(time)
    bounds = [None, *cuts, None]
    return [
        rows.where((at >= low if low else F.lit(True)) & (at < high if high else F.lit(True)))
        for low, high in zip(bounds, bounds[1:])]


def keyed_latest_user(spark, sf_dir):
    """The last record of every user: written in batches, one of them twice and
    the latest records first, compacted between two of them."""
    rows = inputs.activity_log(spark, sf_dir).withColumn(
        "ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
    parts = [part.select("user_id", "ts_us", "event_id", "event_type")
             for part in _slots(rows, "ts", CUTS)]
    table = _new_table(
        spark, "latest-user", schema=parts[0].schema, keys=("user_id",),
        order=("ts_us", "event_id"), buckets=8)
    for number, part in enumerate(reversed(parts)):
        table.upsert(part, "log", number)
        if number == 1:
            table.compact()
            table.upsert(part, "log", number)
    return table.current()


def user_table(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """Users written twice: all of them without gender, then each as it is."""
    users = inputs.users(spark, sf_dir)
    schema = T.StructType([*users.schema.fields, T.StructField("seq", T.LongType())])
    table = _new_table(spark, "users", schema=schema, keys=("id",), order=("seq",), buckets=16)
    table.upsert(users.withColumns({
        "gender": F.lit(None).cast("string"), "seq": F.lit(1).cast("bigint")}), "users", 0)
    table.upsert(users.withColumn("seq", F.lit(2).cast("bigint")), "users", 1)
    return table


def _orders_of_day(spark, sf_dir) -> DataFrame:
    return inputs.table(spark, sf_dir, "orders").where(
        times.in_days("o_orderdate", batch.SEARCH_DAY)).select(*inputs.order_columns())


def keyed_buyers(spark, sf_dir):
    """The orders of a day with their buyers, looked up by key."""
    orders = _orders_of_day(spark, sf_dir)
    known = user_table(spark, sf_dir).lookup(orders.select(F.col("user_id").alias("id")))
    return sales.with_buyers(orders, known, batch.AS_OF).select(
        F.col("id").alias("order_id"), "user_id", "user_gender", "user_age", "user_level",
        F.col("create_date").alias("dt"))


def keyed_amount_hours(spark, sf_dir):
    """Amounts per hour of purchases, added up from batches with one in twice."""
    bought = inputs.table(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select(
        "ts", F.date_format("ts", "yyyy-MM-dd").alias("create_date"),
        F.date_format("ts", "HH").alias("create_hour"),
        F.lit(1).cast("bigint").alias("records"), F.col("value").cast("decimal(38,10)").alias("amount"))
    schema = bought.drop("ts").schema
    table = _new_table(spark, "amounts", schema=schema, keys=("create_date", "create_hour"), buckets=4)
    for number, part in enumerate(_slots(bought, "ts", CUTS)):
        for _ in range(1 + number % 2):
            table.add(part.drop("ts"), "purchases", number)
    return table.current().select(
        "create_date", "create_hour", "records", F.round("amount", 6).cast("double").alias("amount"))


QUERIES = {q.__name__: q for q in (keyed_latest_user, keyed_buyers, keyed_amount_hours)}
