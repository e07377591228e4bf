"""Once per key and day, across micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen_stream(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    keep: str = "2 days",
    day_offset: str = "0 hours",
) -> DataFrame:
    """Emit each (key, day) once, in the batch that brings it first.

    Within that batch the earliest record wins; records of later batches never
    replace it.  The state is an aggregation keyed by the keys and the day: it
    keeps the smallest (batch time, record time, rest), and a row is passed on
    only in the batch whose time it carries.  The batch time is part of the
    offset log, so a replayed batch emits the same rows.  Each task reduces
    its rows to one per key before the shuffle.

    State of a day is dropped ``keep`` after its end.  Run with output mode
    ``update``.  ``day_offset`` shifts the day start for zones other than UTC.
    """
    rest = [c for c in rows.columns if c not in keys and c != ts]
    stamped = rows.withWatermark(ts, keep).withColumn("_batch", F.current_timestamp())
    first = F.min(F.struct("_batch", F.col(ts).alias("_ts", metadata={}), *rest))
    return (
        stamped.groupBy(*keys, F.window(ts, "1 day", "1 day", day_offset).alias("_day"))
        .agg(first.alias("_first"), F.max("_batch").alias("_last"))
        .where(
            (F.col("_first._batch") == F.current_timestamp())
            & (F.col("_last") == F.current_timestamp())
        )
        .select(
            *keys,
            F.col("_first._ts").alias(ts, metadata={}),
            *[F.col("_first")[c].alias(c) for c in rest],
        )
    )
