"""Dates, hours and day ranges.

All formatting follows ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Years 1 to 9999 in epoch milliseconds.
FIRST_MS, LAST_MS = -62135596800000, 253402300799999


def usable_millis(column: str) -> Column:
    """Whether epoch milliseconds name a time in the years 1 to 9999."""
    return F.col(column).between(FIRST_MS, LAST_MS)


def from_millis(column: str) -> Column:
    """Epoch milliseconds to a timestamp; NULL outside the years 1 to 9999."""
    return F.timestamp_millis(F.when(usable_millis(column), F.col(column)))


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hour_text(ts: Column) -> Column:
    return F.date_format(ts, "HH")


def with_log_time(
    df: DataFrame, ts: Column, date_col: str = "logDate", hour_col: str = "logHour"
) -> DataFrame:
    """Add the date and hour a record belongs to."""
    return df.withColumns({date_col: date_text(ts), hour_col: hour_text(ts)})


def with_create_time(df: DataFrame, text: str = "create_time") -> DataFrame:
    """Split ``yyyy-MM-dd HH:mm:ss`` text into ``create_date``, ``create_hour``.

    Text without a blank gives an empty hour.
    """
    return df.withColumns({
        "create_date": F.split_part(F.col(text), F.lit(" "), F.lit(1)),
        "create_hour": F.split_part(
            F.split_part(F.col(text), F.lit(" "), F.lit(2)), F.lit(":"), F.lit(1)
        ),
    })


def previous_day(day: str) -> str:
    return (date.fromisoformat(day) - timedelta(days=1)).isoformat()


def in_days(ts_col: str, first_day: str, days: int = 1) -> Column:
    """Half-open day range as bare comparisons with literals.

    The column is not wrapped in a function, so the range reaches the scan as
    a pushed filter and prunes row groups.
    """
    last = (date.fromisoformat(first_day) + timedelta(days=days - 1)).isoformat()
    return (F.col(ts_col) >= F.lit(first_day)) & until_day(ts_col, last)


def until_day(ts_col: str, last_day: str) -> Column:
    """Everything up to the end of a day, pushed down like ``in_days``."""
    end = (date.fromisoformat(last_day) + timedelta(days=1)).isoformat()
    return F.col(ts_col) < F.lit(end)


def millis(ts_col: str) -> Column:
    """Epoch milliseconds of a timestamp with or without zone."""
    return F.unix_millis(F.col(ts_col).cast("timestamp"))
