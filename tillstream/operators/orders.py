"""Order cleaning and amounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.functions.text import mask_phone
from tillstream.functions.times import with_create_time
from tillstream.functions.records import BAD


def prepare_orders(orders: DataFrame) -> DataFrame:
    """Derive date and hour, mask the phone number.

    When the rows carry a ``_bad`` flag, an unusable ``create_time`` sets it, and
    so does an amount that is no number or is out of any order's range.
    """
    rows = with_create_time(orders).withColumn(
        "consignee_tel", mask_phone("consignee_tel")
    )
    if BAD in rows.columns:
        unusable = F.col("create_hour").isNull() | (F.col("create_hour") == "")
        rows = rows.withColumn(BAD, F.col(BAD) | unusable)
        if "total_amount" in rows.columns:
            amount = F.col("total_amount").cast("double")
            usable = amount.isNull() | (~F.isnan(amount) & (F.abs(amount) < AMOUNT_LIMIT))
            rows = rows.withColumn(BAD, F.col(BAD) | ~usable)
    return rows


AMOUNT_LIMIT = 1e15
EXACT = "decimal(38,10)"


def exact_amount(column: str | Column) -> Column:
    """An amount with ten decimals; NULL if it is no number or does not fit."""
    return F.col(column).try_cast(EXACT) if isinstance(column, str) else column.try_cast(EXACT)


def rounded(total: Column) -> Column:
    """A sum as a double, rounded once, to the sixth decimal."""
    return F.round(total, 6).cast("double")


def amount_sum(column: str) -> Column:
    """Sum of a money column, the same in any order of addition.

    Amounts are added exactly and rounded once.
    """
    return rounded(F.try_sum(exact_amount(column)))


def amount_by(orders: DataFrame, keys: Sequence[Column | str], amount: str) -> DataFrame:
    return orders.groupBy(*keys).agg(amount_sum(amount).alias("amount"))


def amount_total(
    orders: DataFrame, day: str, amount: str = "total_amount",
    date_col: str = "create_date",
) -> DataFrame:
    """Order amount of a day; NULL without orders."""
    return orders.where(F.col(date_col) == day).agg(amount_sum(amount).alias("value"))


def amount_hours(
    orders: DataFrame, amount: str = "total_amount",
    date_col: str = "create_date", hour_col: str = "create_hour",
) -> DataFrame:
    """``day, hour, value`` of the stored order table."""
    return orders.groupBy(
        F.col(date_col).alias("day"), F.col(hour_col).alias("hour")
    ).agg(amount_sum(amount).alias("value"))
