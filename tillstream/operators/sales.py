"""Orders with their details and buyers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR_MS = 365 * 24 * 60 * 60 * 1000


def age_years(birthday: Column, as_of: str | None = None) -> Column:
    """Whole 365-day years from the birthday's midnight to ``as_of`` (or now).

    Not the calendar age.  An unreadable birthday gives NULL.
    """
    born = F.try_to_timestamp(birthday, F.lit("yyyy-MM-dd"))
    now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    gap = F.unix_millis(now) - F.unix_millis(born)
    # Division cut towards zero; exact, both sides are below 2**53.
    return (gap / F.lit(YEAR_MS)).cast("int")


def unique_details(details: DataFrame) -> DataFrame:
    """Drop exact copies of a detail that a feed delivered twice.

    Copies collapse inside each task before the shuffle.
    """
    return details.distinct()


def unique_orders(orders: DataFrame) -> DataFrame:
    """One row per order id: of an order delivered twice, the larger row.

    Copies collapse inside each task before the shuffle.
    """
    rest = [c for c in orders.columns if c != "id"]
    return orders.groupBy("id").agg(F.max(F.struct(*rest)).alias("_o")).select(
        *[F.col(c) if c == "id" else F.col("_o")[c].alias(c) for c in orders.columns])


def join_details(
    orders: DataFrame,
    details: DataFrame,
    ttl: str | None = None,
    order_time: str = "order_time",
    detail_time: str = "detail_time",
) -> DataFrame:
    """Inner join of orders and details, each pair once, as sale rows.

    With ``ttl`` (an interval text) a pair counts only when both arrived within
    it, in either order.  Orders are unique by id; a hot order therefore sits
    on the detail side only, which adaptive execution splits.
    """
    o = orders.alias("o")
    d = details.alias("d")
    match = F.col("o.id") == F.col("d.order_id")
    if ttl:
        match &= ttl_condition(
            F.col(f"o.{order_time}"), F.col(f"d.{detail_time}"), ttl
        )
    buyer = [F.col(f"o.{c}") for c in BUYER_COLUMNS if c in orders.columns]
    return o.join(d, match, "inner").select(*sale_columns(), *buyer)


def ttl_condition(left: Column, right: Column, ttl: str) -> Column:
    span = F.expr(f"INTERVAL {ttl}")
    return (right >= left - span) & (right <= left + span)


def sale_columns(order: str = "o", detail: str = "d") -> list[Column]:
    """The order and detail part of a sale row."""
    return [
        F.col(f"{detail}.id").alias("order_detail_id"),
        F.col(f"{order}.id").alias("order_id"),
        F.col(f"{order}.order_status").alias("order_status"),
        F.col(f"{order}.create_time").alias("create_time"),
        F.col(f"{order}.user_id").alias("user_id"),
        F.col(f"{detail}.sku_id").alias("sku_id"),
        F.col(f"{detail}.order_price").try_cast("double").alias("sku_price"),
        F.col(f"{detail}.sku_name").alias("sku_name"),
        F.col(f"{order}.create_date").alias("dt"),
    ]


BUYER_COLUMNS = ["user_gender", "user_age", "user_level"]


def buyers(users: DataFrame, as_of: str | None = None) -> DataFrame:
    """``user_id`` with gender, age and level."""
    return users.select(
        F.col("id").alias("user_id"),
        F.col("gender").alias("user_gender"),
        age_years(F.col("birthday"), as_of).alias("_age"),
        F.col("user_level"),
    )


def with_buyers(rows: DataFrame, users: DataFrame, as_of: str | None = None) -> DataFrame:
    """Add the buyer to rows with ``user_id``; unknown buyers keep age 0.

    Join orders, or counts per buyer, rather than joined sale rows: the sales
    then need no second shuffle, and a buyer with many sales is no hot key.
    """
    return rows.join(buyers(users, as_of), "user_id", "left").select(
        *rows.columns, "user_gender", F.coalesce("_age", F.lit(0)).alias("user_age"), "user_level",
    )


SALE_ORDER = [
    "order_detail_id", "order_id", "order_status", "create_time", "user_id", "sku_id",
    "user_gender", "user_age", "user_level", "sku_price", "sku_name", "dt",
]


def enrich_users(
    sales: DataFrame, users: DataFrame, as_of: str | None = None
) -> DataFrame:
    """Add gender, age and level of the buyer; unknown buyers keep age 0.

    ``users`` has one row per id and should be a stored table: then both join
    sides are plain shuffles, so Catalyst broadcasts the users only when their
    size allows and adaptive execution splits a hot buyer otherwise.
    """
    return with_buyers(sales, users, as_of).select(*SALE_ORDER)
