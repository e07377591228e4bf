"""Dashboard results: KPI cards and the two-day hourly comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.functions.times import previous_day
from tillstream.operators import activity, orders as order_ops

# Ids and names of the dashboard cards.
CARD_NAMES = {
    "dau": "新增日活",
    "new_mid": "新增设备",
    "order_amount": "新增交易额",
}


def compare_days(hours: DataFrame, day: str) -> DataFrame:
    """``hour, today, yesterday`` for hours with data on either day.

    ``hours`` is ``day, hour, value``; both days come from one scan.
    """
    before = previous_day(day)
    return (
        hours.where(F.col("day").isin(day, before))
        .groupBy("hour")
        .agg(
            F.sum(F.when(F.col("day") == day, F.col("value"))).alias("today"),
            F.sum(F.when(F.col("day") == before, F.col("value"))).alias("yesterday"),
        )
    )


def fill_hours(compared: DataFrame) -> DataFrame:
    """All 24 hours, 0 where a day has nothing."""
    spine = compared.sparkSession.range(24).select(
        F.format_string("%02d", "id").alias("hour")
    )
    zero = F.lit(0)
    return spine.join(compared, "hour", "left").select(
        "hour",
        F.coalesce("today", zero).alias("today"),
        F.coalesce("yesterday", zero).alias("yesterday"),
    )


def hourly_metric(
    metric: str, day: str, dau: DataFrame, orders: DataFrame
) -> DataFrame:
    """Hourly comparison of metric ``dau`` or ``order_amount``.

    Any other metric has no rows.
    """
    sources = {
        "dau": lambda: activity.dau_hours(dau),
        "order_amount": lambda: order_ops.amount_hours(orders),
    }
    if metric not in sources:
        return dau.sparkSession.createDataFrame(
            [], "hour string, today double, yesterday double"
        )
    return compare_days(sources[metric](), day)


def as_hour_maps(compared: DataFrame) -> DataFrame:
    """The comparison as one JSON object of two hour maps (24 entries at most)."""

    def pairs(name: str):
        # One row per hour with data, so the lists hold at most 24 entries.
        return F.map_from_entries(
            F.collect_list(
                F.when(F.col(name).isNotNull(), F.struct("hour", F.col(name)))
            )
        ).alias(name)

    return compared.agg(pairs("yesterday"), pairs("today")).select(
        F.to_json(F.struct("yesterday", "today")).alias("value")
    )


def card(value: DataFrame, card_id: str) -> DataFrame:
    return value.select(
        F.lit(card_id).alias("id"), F.lit(CARD_NAMES[card_id]).alias("name"),
        F.col("value").cast("double").alias("value"),
    )


def kpi_cards(
    dau_value: DataFrame, new_value: DataFrame, amount_value: DataFrame
) -> DataFrame:
    """Three cards from three one-row frames with a ``value`` column."""
    return (
        card(dau_value, "dau")
        .unionByName(card(new_value, "new_mid"))
        .unionByName(card(amount_value, "order_amount"))
    )


def realtime_total(dau: DataFrame, orders: DataFrame, day: str) -> DataFrame:
    """The KPI cards of a day from the stored device and order tables."""
    return kpi_cards(
        activity.dau_total(dau, day),
        activity.new_total(dau, day),
        order_ops.amount_total(orders, day),
    )


def cards_json(cards: DataFrame) -> DataFrame:
    """The card list as one JSON array (one element per card)."""
    return cards.agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("id", "name", "value")))).alias("value")
    )
