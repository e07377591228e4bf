"""Daily active and new devices.

The counts need only the first time per device and day, never the whole row:
their aggregation state is a date and a timestamp, which keeps them in hash
aggregation, and the two-level grouping makes exact distinct counts safe for
hot devices and hot days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.functions import times


def first_touch(logs: DataFrame, device: str, ts: str) -> DataFrame:
    """``day, device, first_ts``: first time of a device on each day."""
    return logs.groupBy(F.to_date(ts).alias("day"), device).agg(
        F.min(ts).alias("first_ts")
    )


def active_by_day(logs: DataFrame, device: str, ts: str) -> DataFrame:
    """Active devices per day, straight from raw logs."""
    days = logs.select(F.to_date(ts).alias("day"), device).distinct()
    return (
        days.groupBy("day").agg(F.count("*").alias("dau"))
        .select(F.date_format("day", "yyyy-MM-dd").alias("log_date"), "dau")
    )


def active_by_hour(logs: DataFrame, device: str, ts: str) -> DataFrame:
    """Active devices per day and hour of their first record."""
    return (
        first_touch(logs, device, ts)
        .groupBy("day", F.hour("first_ts").alias("hour"))
        .agg(F.count("*").alias("dau"))
        .select(
            F.date_format("day", "yyyy-MM-dd").alias("log_date"),
            F.format_string("%02d", "hour").alias("log_hour"),
            "dau",
        )
    )


def new_by_day(logs: DataFrame, device: str, ts: str) -> DataFrame:
    """Devices per day of their first appearance ever."""
    born = logs.groupBy(device).agg(F.min(ts).alias("first_ts"))
    return (
        born.groupBy(F.to_date("first_ts").alias("day"))
        .agg(F.count("*").alias("new_devices"))
        .select(F.date_format("day", "yyyy-MM-dd").alias("log_date"), "new_devices")
    )


def dau_total(dau: DataFrame, day: str, date_col: str = "logDate") -> DataFrame:
    """Rows of the stored device table on a day; 0 when there are none."""
    return dau.where(F.col(date_col) == day).agg(F.count("*").alias("value"))


def new_total(dau: DataFrame, day: str, date_col: str = "logDate", device: str = "mid") -> DataFrame:
    """Devices of the stored table whose first day is ``day``.

    Later days cannot change the answer and are pruned.
    """
    first = (
        dau.where(F.col(date_col) <= day)
        .groupBy(device).agg(F.min(F.to_date(date_col)).alias("first_day"))
    )
    return first.where(F.col("first_day") == day).agg(F.count("*").alias("value"))


def dau_hours(
    dau: DataFrame, date_col: str = "logDate", hour_col: str = "logHour"
) -> DataFrame:
    """``day, hour, value`` of the stored device table."""
    return (
        dau.groupBy(F.col(date_col).alias("day"), F.col(hour_col).alias("hour"))
        .agg(F.count("*").alias("value"))
    )


def records_per_interval(logs: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Record count per micro-batch interval."""
    slot = (times.millis(ts) / F.lit(1000 * seconds)).cast("bigint") * seconds
    return logs.groupBy(slot.alias("batch_start")).agg(F.count("*").alias("records"))
