"""String helpers: masking and naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHONE_PREFIX = 4
PHONE_STARS = 7


def mask_phone(column: str) -> Column:
    """First four characters, then seven stars whatever the length; NULL stays."""
    return F.concat(
        F.substring(F.col(column), 1, PHONE_PREFIX), F.lit("*" * PHONE_STARS)
    )


def upper_names(df: DataFrame) -> DataFrame:
    """Upper-case column names, the naming of the stored tables."""
    return df.toDF(*[name.upper() for name in df.columns])
