"""Orders and details arriving as two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.operators.sales import SALE_ORDER, age_years, sale_columns, ttl_condition
from tillstream.streaming.packs import join_packed

# What a sale row takes from either side.
ORDER_SIDE = ["id", "order_status", "create_time", "user_id", "create_date"]
DETAIL_SIDE = ["id", "sku_id", "order_price", "sku_name"]


def join_streams(
    orders: DataFrame,
    details: DataFrame,
    order_time: str = "order_time",
    detail_time: str = "detail_time",
    ttl: str = "100 seconds",
    lateness: str = "10 seconds",
    salts: int = 1,
    drop_copies: bool = True,
    packs: int | None = None,
) -> DataFrame:
    """Pairs of order and detail that arrive within ``ttl``, in either order.

    Both sides leave the state once no partner can come any more.  Adaptive
    execution does not reach stateful joins; where an order may have very many
    details, ``salts`` holds each order that many times and spreads its details
    over as many tasks.

    ``drop_copies`` removes orders and details that a feed delivered twice
    within the lateness, so a pair comes out once.

    With ``packs`` the state has that many packs of rows instead of single rows
    (``streaming.packs``), for feeds with many rows a batch: a batch writes the
    packs of its keys anew, and a task holds a pack in memory.
    """
    left = orders.withWatermark(order_time, lateness)
    if drop_copies:
        left = left.dropDuplicatesWithinWatermark(["id"])
    left = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = details.withWatermark(detail_time, lateness)
    if drop_copies:
        right = right.dropDuplicatesWithinWatermark(["order_id", "id"])
    right = right.withColumn(
        "_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    )
    if packs:
        met = join_packed(
            left, right, *[[F.col(c), F.col("_salt")][:1 + (salts > 1)] for c in ("id", "order_id")],
            order_time, detail_time, ORDER_SIDE, DETAIL_SIDE, ttl, packs)
        return met.select(*sale_columns())
    match = (
        (F.col("o.id") == F.col("d.order_id"))
        & (F.col("o._salt") == F.col("d._salt"))
        & ttl_condition(F.col(f"o.{order_time}"), F.col(f"d.{detail_time}"), ttl)
    )
    return left.alias("o").join(right.alias("d"), match, "inner").select(*sale_columns())


def join_late_users(
    sales: DataFrame,
    users: DataFrame,
    sale_time: str = "sale_time",
    user_time: str = "user_time",
    wait: str = "100 seconds",
    reach: str = "1 day",
    lateness: str = "10 seconds",
    as_of: str | None = None,
) -> DataFrame:
    """Sale rows with their buyer, also when the buyer's row comes after the sale.

    A buyer's row counts for sales from ``wait`` before it to ``reach`` after it.
    A sale whose buyer is known comes out at once.  One without waits in the
    state and comes out once, with the defaults of an unknown buyer, when the
    watermarks of both streams say that no row can come any more.  A sale meets
    every row of its buyer in that span, so ``users`` should have one.
    """
    left = sales.withWatermark(sale_time, lateness).alias("s")
    right = users.withWatermark(user_time, lateness).alias("u")
    sold, known = F.col(f"s.{sale_time}"), F.col(f"u.{user_time}")
    near = (known <= sold + F.expr(f"INTERVAL {wait}")) & (known >= sold - F.expr(f"INTERVAL {reach}"))
    met = left.join(right, (F.col("s.user_id") == F.col("u.id")) & near, "left_outer")
    age = F.coalesce(age_years(F.col("u.birthday"), as_of), F.lit(0))
    buyer = {"user_gender": F.col("u.gender"), "user_age": age, "user_level": F.col("u.user_level")}
    return met.select(*[buyer.get(c, F.col(f"s.{c}")).alias(c) for c in SALE_ORDER])
