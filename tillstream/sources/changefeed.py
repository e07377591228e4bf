"""Database change feed to single change rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.schemas import CHANGE_ENTRY

ROW_DATA = "ROWDATA"


def parse_entries(
    lines: DataFrame, value: str = "value", carry: Sequence[str] = ()
) -> DataFrame:
    """JSON change entries to columns, beside the columns to ``carry``."""
    return lines.select(F.from_json(value, CHANGE_ENTRY).alias("e"), *carry).select("e.*", *carry)


def change_rows(
    entries: DataFrame, database: str | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """``table_name, event_type, after``: one row per changed row, in their order.

    Entries other than row data (transaction marks) are dropped, and with
    ``database`` those of other databases, whatever their tables are called.
    """
    if database is not None:
        entries = entries.where(F.col("database_name") == database)
    return (
        entries.where(F.col("entry_type") == ROW_DATA)
        .select("table_name", "event_type", F.explode("row_datas.after").alias("after"), *carry)
    )
