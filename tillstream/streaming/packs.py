"""A join of two streams whose state is kept in packs of rows.

Spark's own join writes, reads and removes every row of both sides in the state
one by one.  Here the rows of both sides are dealt to packs by a hash of their
key; the state has one row a pack, with all that is held of both sides in Arrow's
format, and a batch meets a pack as a whole.  Watermark, checkpoint and state
store are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDES = ("left", "right")
#: Of the state: an Arrow table of key, time in microseconds and row for each side.
HELD = T.StructType([T.StructField(side, T.BinaryType()) for side in SIDES])
MET = T.StructType([T.StructField(side, T.StringType()) for side in SIDES])
COLUMNS = ["key", "time", "row"]


def span_micros(spark: SparkSession, span: str) -> int:
    """Microseconds of an interval text of days and smaller units."""
    row = spark.range(1).select(F.expr(f"INTERVAL {span}").alias("span"))
    if not isinstance(row.schema["span"].dataType, T.DayTimeIntervalType):
        raise ValueError(f"packs need a span of days, hours, minutes or seconds: {span}")
    return row.first()["span"] // timedelta(microseconds=1)


def packed(rows: pd.DataFrame) -> bytes | None:
    if rows.empty:
        return None
    table = pa.Table.from_pandas(rows, preserve_index=False, nthreads=1).replace_schema_metadata(None)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(pack: bytes | None) -> pd.DataFrame | None:
    if pack is None:
        return None
    return pa.ipc.open_stream(bytes(pack)).read_all().to_pandas(use_threads=False)


def _pairs(left: list, right: list, span: int) -> pd.DataFrame:
    """Rows of both sides with one key and times at most ``span`` apart."""
    left, right = ([x for x in side if x is not None and len(x)] for side in (left, right))
    if not left or not right:
        return pd.DataFrame({side: [] for side in SIDES}, dtype=object)
    met = pd.concat(left).merge(pd.concat(right), on="key", suffixes=("_left", "_right"))
    met = met[np.abs(met["time_left"] - met["time_right"]) <= span]
    return pd.DataFrame({side: met[f"row_{side}"] for side in SIDES})


def _meet(span: int):
    """The function of a batch and a pack."""

    def meet(_, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        held = [unpacked(pack) for pack in (state.get if state.exists else (None, None))]
        new = [None, None]
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            new = [rows.loc[rows["side"] == n, COLUMNS] for n in (0, 1)]
            # each pair once: new with new and held, then held with new
            for met in (_pairs([new[0]], [new[1], held[1]], span), _pairs([held[0]], [new[1]], span)):
                if len(met):
                    yield met
        kept = []
        for old, more in zip(held, new):
            rows = [x[x["time"] >= mark - span] for x in (old, more) if x is not None]
            rows = [x for x in rows if len(x)]
            kept.append(pd.concat(rows) if rows else pd.DataFrame(columns=COLUMNS))
        if all(x.empty for x in kept):
            if state.exists:
                state.remove()
            return
        state.update(tuple(packed(x) for x in kept))
        oldest = min(int(x["time"].min()) for x in kept if len(x))
        state.setTimeoutTimestamp(max((oldest + span) // 1000, mark // 1000 + 1))

    return meet


def _side(rows: DataFrame, n: int, keys: list[Column], time: str, names: list[str], packs: int) -> DataFrame:
    """Rows of a side as pack, key, time and the text of their columns."""
    texts = F.to_json(F.array(*[F.col(c).cast("string") for c in names]))
    # the watermark goes with the time, so that Spark drops late rows and ends what is held
    micros = F.unix_micros(F.col(time)).alias("time", metadata=rows.schema[time].metadata)
    key = keys[0] if len(keys) == 1 else F.to_json(F.array(*[k.cast("string") for k in keys]))
    return rows.where(keys[0].isNotNull() & F.col(time).isNotNull()).select(
        F.pmod(F.xxhash64(*keys), F.lit(packs)).cast("int").alias("pack"),
        key.alias("key"), micros,
        F.lit(n).cast("byte").alias("side"), texts.alias("row"))


def join_packed(
    left: DataFrame, right: DataFrame, left_keys: list[Column], right_keys: list[Column],
    left_time: str, right_time: str, left_names: list[str], right_names: list[str],
    span: str, packs: int,
) -> DataFrame:
    """Inner join of two streams with watermarks, on the keys and times at most ``span`` apart.

    Both sides come out as structs ``o`` and ``d`` of their named columns, which
    have atomic types.  Rows without a key or time meet nothing; late rows are
    dropped by Spark.  A row leaves the state when the watermark is more than
    ``span`` after it.  Keys have the same type on both sides, an integer or text.
    A pack's rows are in the memory of one task, those of one key too.
    """
    sides = [_side(left, 0, left_keys, left_time, left_names, packs),
             _side(right, 1, right_keys, right_time, right_names, packs)]
    if sides[0].schema["key"].dataType != sides[1].schema["key"].dataType:
        raise ValueError("the keys of both sides need one type")
    met = sides[0].unionByName(sides[1]).groupBy("pack").applyInPandasWithState(
        _meet(span_micros(left.sparkSession, span)), MET, HELD, "append", "EventTimeTimeout")

    def struct(side: str, rows: DataFrame, names: list[str]) -> Column:
        texts = F.from_json(side, "array<string>")
        return F.struct(*[texts[i].cast(rows.schema[c].dataType).alias(c) for i, c in enumerate(names)])

    return met.select(struct("left", left, left_names).alias("o"), struct("right", right, right_names).alias("d"))


def held_times(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``side, time`` of every row that the state of a packed join holds."""

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side in SIDES:
                for pack in batch.column(side):
                    if pack.is_valid:
                        time = pa.ipc.open_stream(pack.as_buffer()).read_all()["time"].combine_chunks()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([side] * len(time), pa.string()), time.cast(pa.int64())], ["side", "micros"])

    state = spark.read.format("statestore").load(checkpoint)
    packs = state.select(*[F.col(f"value.groupState.{side}").alias(side) for side in SIDES])
    return packs.mapInArrow(times, "side string, micros long").select(
        "side", F.timestamp_micros("micros").alias("time"))
