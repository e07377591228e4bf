"""JSON lines to typed rows, and rows back to JSON."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"
RAW = "_raw"


def parse_lines(
    lines: DataFrame,
    schema: T.StructType,
    required: Iterable[str],
    value: str = "value",
) -> DataFrame:
    """Parse a JSON text column into ``schema``.

    Each field is read as text and then ``try_cast``: quoted and bare numbers
    both parse, and an unreadable one becomes NULL instead of an error.  Rows
    that are not JSON objects, lose a value in the cast or miss a required
    field have ``_bad`` set; ``_raw`` keeps the line.  Other input columns are
    kept.

    ``json_tuple`` is a generator, which the optimizer does not copy into the
    filters and columns above it: every line is parsed exactly once.
    """
    names = [f.name for f in schema]
    passed = [c for c in lines.columns if c != value]
    rows = lines.select(
        *passed, F.col(value).alias(RAW), F.json_tuple(value, *names).alias(*names)
    )
    casts: dict[str, Column] = {}
    # A line that is not a JSON object has no fields at all.
    faults: list[Column] = [F.col(name).isNull() for name in required]
    for field in schema:
        if not isinstance(field.dataType, T.StringType):
            cast = F.col(field.name).try_cast(field.dataType)
            casts[field.name] = cast
            faults.append(F.col(field.name).isNotNull() & cast.isNull())
    return rows.withColumn(BAD, reduce(or_, faults)).select(
        *passed,
        *[casts[n].alias(n) if n in casts else F.col(n) for n in names],
        BAD,
        RAW,
    )


def flag(parsed: DataFrame, fault: Column) -> DataFrame:
    """Set ``_bad`` where a further fault holds (NULL counts as one)."""
    return parsed.withColumn(BAD, F.col(BAD) | F.coalesce(fault, F.lit(True)))


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col(BAD)).drop(BAD, RAW)


def bad_rows(parsed: DataFrame) -> DataFrame:
    """The quarantine: raw lines that could not be used."""
    return parsed.where(F.col(BAD)).select(F.col(RAW).alias("value"))


def to_line(columns: Iterable[str]) -> Column:
    """The named columns as one JSON object."""
    return F.to_json(F.struct(*columns))
