"""The benchmark tables in the roles of the feeds.

``events`` is the activity log (device = user), ``events`` with the device of
``props.k`` the coupon log, ``orders`` / ``lineitem`` / ``customer`` the order,
detail and user tables.  Keys keep their numeric types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str) -> Column:
    """Cents-exact text of a money column, as a change feed would carry it."""
    return F.col(column).cast("decimal(18,2)").cast("string")


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "ts", "user_id", "event_id", "event_type"
    )


def coupon_columns() -> list[Column]:
    return [
        F.get_json_object("props", "$.k").alias("mid"),
        F.col("user_id").cast("string").alias("uid"),
        F.col("event_type").alias("evid"),
        F.floor("value").cast("string").alias("itemid"),
        F.col("ts").alias("event_time"),
    ]


def coupon_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases stand for coupons, clicks for clicks."""
    return table(spark, sf_dir, "events").select(*coupon_columns())


def order_columns() -> list[Column]:
    return [
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("order_status"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("create_time"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("create_date"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("total_amount"),
        F.col("o_orderdate").alias("order_time"),
    ]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*order_columns())


def detail_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def detail_columns() -> list[Column]:
    return [
        detail_id().alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"),
        F.concat("l_returnflag", "l_linestatus").alias("sku_name"),
        F.col("l_extendedprice").alias("order_price"),
        F.col("l_shipdate").alias("detail_time"),
    ]


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*detail_columns())


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sku_id"), F.col("p_name").alias("sku_name")
    )


def named_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details whose item name comes from the part table."""
    return details(spark, sf_dir).drop("sku_name").join(item_names(spark, sf_dir), "sku_id")


def user_columns() -> list[Column]:
    """The account balance in days before 2008 stands for the birthday."""
    birthday = F.date_sub(F.lit("2008-01-01").cast("date"), F.floor("c_acctbal").cast("int"))
    return [
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("login_name"),
        F.col("c_nationkey").cast("string").alias("user_level"),
        F.date_format(birthday, "yyyy-MM-dd").alias("birthday"),
        F.col("c_mktsegment").alias("gender"),
    ]


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(*user_columns())
