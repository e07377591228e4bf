"""Coupon-abuse alerts on a stream.

The state holds one row per device, member and slide step, and nothing per
window.  Steps that the watermark has closed are stored, and the windows they
complete are counted by the batch plan of ``operators.alerts``, which gives the
alerts with everything they list.

Every record also says how far the watermark will go because of it: a ``clock``
row in the slide step that ends there.  The aggregation gives that row out once
the watermark has arrived, in a batch without records as well, so windows are
closed by the watermark and not by the next record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.operators.alerts import (
    AlertRule, alert_members, alerts_from, merged_spans,
)
from tillstream.sources.keyed import KeyedTable
from tillstream.sources.tables import BATCH, WRITER, read_table, write_batch, writer_id

STEPS = T.StructType([
    T.StructField("mid", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("member", T.StringType()), T.StructField("at", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("step_date", T.StringType()),
])
ALERTS = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("mid", T.StringType()),
    T.StructField("window_end", T.LongType()), T.StructField("users", T.LongType()),
    T.StructField("items", T.LongType()), T.StructField("events", T.LongType()),
    T.StructField("alert_date", T.StringType()),
])
MEMBERS = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("window_end", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("member", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("alert_date", T.StringType()),
])


def step_members(
    events: DataFrame, rule: AlertRule = AlertRule(), lateness: str = "10 seconds"
) -> DataFrame:
    """Members per slide step, once the watermark has passed it: ``STEPS`` rows.

    ``at`` is the end of the step.  Kinds are ``user`` and ``item`` of coupon
    records and ``event`` of all records; ``n`` counts repeats.  A row of kind
    ``clock``, without device and member, says that the watermark has passed
    ``at``; the largest of a batch is the watermark rounded down to a step.
    """
    timed = events.where(F.col(rule.device).isNotNull()).select(
        F.col(rule.ts).cast("timestamp").alias("_time"),
        F.col(rule.device).cast("string").alias("mid"),
        F.col(rule.user).cast("string").alias("uid"),
        F.col(rule.item).cast("string").alias("itemid"), F.col(rule.event).alias("evid"),
    ).withWatermark("_time", lateness)
    is_coupon = F.col("evid") == rule.coupon
    reached = F.unix_millis(F.col("_time") - F.expr(f"INTERVAL {lateness}"))
    clock = F.timestamp_millis(reached - F.pmod(reached, F.lit(rule.slide_ms)) - rule.slide_ms)

    def entry(kind: str, mid: Column, member: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), mid.alias("mid"),
                        member.alias("member"), at.alias("at"))

    none = F.lit(None).cast("string")
    mid, time = F.col("mid"), F.col("_time")
    entries = timed.select(F.inline(F.array(
        entry("user", mid, F.when(is_coupon, F.col("uid")), time),
        entry("item", mid, F.when(is_coupon, F.col("itemid")), time),
        entry("event", mid, F.col("evid"), time),
        entry("clock", none, none, clock),
    )))
    # The steps of all entries are under the watermark of the records' time.
    marked = F.col("at").alias("_time", metadata=timed.schema["_time"].metadata)
    return (
        entries.where(F.col("member").isNotNull() | F.col("kind").isin("event", "clock"))
        .select("kind", "mid", "member", marked)
        .groupBy(F.window("_time", f"{rule.slide_ms} milliseconds").alias("step"),
                 "mid", "kind", "member")
        .agg(F.count("*").alias("n"))
        .select("mid", "kind", "member", F.unix_millis("step.end").alias("at"), "n",
                F.date_format("step.end", "yyyy-MM-dd").alias("step_date"))
    )


def pieces_until(steps: DataFrame, rule: AlertRule, closed: int) -> DataFrame:
    """Pieces of the windows that end at ``closed`` (epoch milliseconds) or before."""
    taken = steps.where(F.col("kind").isin("user", "item")).select(
        "mid", "kind", "member", "at").distinct()
    spans = merged_spans(taken, rule).withColumn("n", F.lit(1).cast("bigint"))
    events = steps.where(F.col("kind") == "event").groupBy(
        "mid", "kind", "member", F.col("at").alias("start")
    ).agg(F.sum("n").alias("n")).withColumn("end", F.col("start") + rule.window_ms)
    pieces = spans.unionByName(events)
    return pieces.withColumn("end", F.least("end", F.lit(closed + rule.slide_ms))).where(
        F.col("start") < F.col("end"))


def alert_table(spark: SparkSession, path: str) -> KeyedTable:
    """Current alerts: one row per device and minute, that of its last window."""
    return KeyedTable(spark, f"{path}/alerts", ALERTS, ("alert_date", "doc_id"), ("window_end",))


def member_table(spark: SparkSession, path: str) -> KeyedTable:
    """What alerts list; rows of a window that a later one replaced may remain."""
    return KeyedTable(spark, f"{path}/members", MEMBERS,
                      ("alert_date", "doc_id", "kind", "member"), ("window_end",))


def alert_writer(path: str, rule: AlertRule):
    """Batch writer: stores closed steps under ``path/steps`` and upserts the
    alerts of the windows they complete, and their members, by document id.

    Windows up to the watermark are final.  A minute that is complete only in
    part gives its last alert so far, which a later batch replaces.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, me = batch.sparkSession, writer_id(batch)
        batch.persist()
        try:
            closed = batch.agg(F.max("at").alias("at")).first()["at"]
            if closed is None:
                return
            # Of the clock only its last row is worth keeping.
            kept = batch.where((F.col("kind") != "clock") | (F.col("at") == closed))
            write_batch(kept, f"{path}/steps", batch_id, ["step_date"], me)
        finally:
            batch.unpersist()
        mine = read_table(spark, f"{path}/steps", STEPS).where(F.col(WRITER) == me)
        earlier = mine.where(F.col(BATCH) < batch_id)
        # The day is a folder: only the last one is read for the last step.
        day = earlier.agg(F.max("step_date").alias("d")).first()["d"]
        before = None if day is None else earlier.where(
            F.col("step_date") == day).agg(F.max("at").alias("at")).first()["at"]
        known = mine.where(F.col(BATCH) <= batch_id)
        if before is not None:
            first = before // rule.grain_ms * rule.grain_ms - rule.window_ms
            from_day = F.date_format(F.timestamp_millis(F.lit(first)), "yyyy-MM-dd")
            known = known.where((F.col("step_date") >= from_day) & (F.col("at") > first))
        pieces = pieces_until(known, rule, closed)
        found = alerts_from(pieces, rule).where(F.col("window_end") > (before or 0)).select(
            *ALERTS.fieldNames())
        found.persist()
        try:
            members = alert_members(found, pieces, rule).join(
                found.select("doc_id", "window_end"), "doc_id").select(*MEMBERS.fieldNames())
            # Members first: an alert that can be read has all it lists.
            member_table(spark, path).upsert(members, me, batch_id)
            alert_table(spark, path).upsert(found, me, batch_id)
        finally:
            found.unpersist()

    return write


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts: per device and minute that of its last window."""
    return alert_table(spark, path).current().select(
        "doc_id", "alert_date", "mid", "window_end", "users", "items", "events")


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """What each alert lists: ``doc_id, alert_date, kind, member, n``."""
    last = read_alerts(spark, path).select("alert_date", "doc_id", "window_end")
    return member_table(spark, path).current().join(
        last, ["alert_date", "doc_id", "window_end"]
    ).select("doc_id", "alert_date", "kind", "member", "n")
