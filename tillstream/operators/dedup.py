"""First and latest record per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], choose
) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    best: Column = choose(F.struct(*order, *rest)).alias("_best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(
        *[F.col(c) if c in keys else F.col("_best")[c].alias(c) for c in df.columns]
    )


def first_record(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest whole row per key; ties fall to the remaining columns.

    An aggregate rather than a window: each task reduces its rows to one per
    key before the shuffle, so a key with a third of all rows costs one row
    per task.
    """
    return _pick(df, keys, order, F.min)


def latest_record(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last written row per key."""
    return _pick(df, keys, order, F.max)


def unseen_first(
    batch: DataFrame, seen: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """First record per key of a batch, for keys not stored before.

    Reduced before the anti join: the join then sees one row per key and no
    hot key, whatever the batch holds.
    """
    return first_record(batch, keys, order).join(
        seen.select(*keys), list(keys), "left_anti"
    )
