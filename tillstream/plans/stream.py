"""The streaming operators over the benchmark tables.

Each query runs a stream over whole tables until everything available is
processed, stores its output in the shared checkpoint folder and returns the
stored table.  Replays deliver a table in time slots: each slot is added to the
feed and the query resumes from its checkpoint, so state is kept, expires and is
restored between batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstream.functions import times
from tillstream.operators.routing import Topics
from tillstream.plans import batch, inputs
from tillstream.session import checkpoint_root, release, remove, remove_at_exit, settings
from tillstream.sources.tables import BATCH, WRITER, WRITTEN, read_latest, read_table
from tillstream.streaming import jobs, metrics
from tillstream.streaming.alerts import alert_writer, read_alerts, read_members, step_members
from tillstream.streaming.dedup import first_seen_stream
from tillstream.streaming.hours import read_hours, with_hours
from tillstream.streaming.packs import held_times
from tillstream.streaming.sales import join_late_users, join_streams

LATENESS_HOURS = 1


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, be it one file or a folder of files.

    The path is written as a pattern because a file stream takes a plain path
    for a folder.
    """
    schema = inputs.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _store(rows: DataFrame, name: str, mode: str = "append", writer=None) -> str:
    """Run the stream to its end; the folder of its output."""
    place = f"{checkpoint_root(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    remove_at_exit(rows.sparkSession, place)
    query = jobs.start(
        rows, f"{name}-{uuid.uuid4().hex}",
        (writer or jobs.table_writer)(f"{place}/table"),
        mode=mode, trigger=jobs.ALL_AVAILABLE, checkpoint=f"{place}/checkpoint",
    )
    query.awaitTermination()
    return f"{place}/table"


def stream_first_seen(spark, sf_dir):
    log = times.with_log_time(
        table_stream(spark, sf_dir, "events").select(
            F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id", "event_type"
        ),
        F.col("ts"), "log_date", "log_hour",
    )
    first = first_seen_stream(log, ["log_date", "user_id"], "ts")
    path = _store(first, "first-seen", mode="update")
    return batch.log_rows(read_table(spark, path, first.schema))


def stream_sale_detail(spark, sf_dir):
    orders = table_stream(spark, sf_dir, "orders").select(*inputs.order_columns())
    details = table_stream(spark, sf_dir, "lineitem").select(*inputs.detail_columns())
    orders = orders.withColumn("order_time", F.col("order_time").cast("timestamp"))
    details = details.withColumn("detail_time", F.col("detail_time").cast("timestamp"))
    sales = join_streams(
        orders, details, ttl="100 days", lateness="4000 days", drop_copies=False
    )
    return read_table(spark, _store(sales, "sales"), sales.schema).drop(WRITTEN, WRITER, BATCH)


def stream_latest_user(spark, sf_dir):
    rows = table_stream(spark, sf_dir, "events").select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "event_id", "event_type",
    )
    path = _store(rows, "users")
    return read_latest(spark, path, ["user_id"], ["ts_us", "event_id"], rows.schema)


def _alert_tables(spark, sf_dir) -> str:
    events = table_stream(spark, sf_dir, "events").select(*inputs.coupon_columns())
    steps = step_members(events, batch.DAY_RULE, lateness=f"{LATENESS_HOURS} hours")
    return _store(steps, "alerts", writer=lambda path: alert_writer(path, batch.DAY_RULE))


def stream_coupon_alert(spark, sf_dir):
    """Alerts of all windows up to the watermark."""
    return read_alerts(spark, _alert_tables(spark, sf_dir))


def stream_alert_members(spark, sf_dir):
    return read_members(spark, _alert_tables(spark, sf_dir))


# Slots of the replays; a table's rows before the first cut are its first delivery.
EVENT_CUTS = ("2024-01-09", "2024-01-16", "2024-01-24")
SALE_CUTS = ("1997-01-01", "1998-07-01", "2000-01-01", "2001-01-01")
SALE_TTL, SALE_LATENESS = "100 days", "30 days"
PACK_ROWS = 50_000  # of both feeds in a pack's share of the keys
# A slot is one batch or two, so a store is closed after each, and two versions of
# the state are kept instead of 100.
SLOT_STATE = {
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


class Replay:
    """Tables delivered slot by slot to the feeds of one query."""

    def __init__(self, spark: SparkSession, name: str, cuts: tuple[str, ...]) -> None:
        self.spark, self.cuts, self.feeds = spark, cuts, {}
        self.name = f"{name}-{uuid.uuid4().hex}"
        self.place = f"{checkpoint_root(spark)}/{self.name}"
        self.checkpoint = f"{self.place}/checkpoint"
        remove_at_exit(spark, self.place)

    def feed(self, rows: DataFrame, time: str) -> DataFrame:
        """The stream that will bring these rows, by the slot of their time."""
        folder = f"{self.place}/feed-{len(self.feeds)}"
        self.feeds[folder] = (rows, time)
        rows.where(F.lit(False)).write.parquet(folder)  # a stream needs its folder
        return self.spark.readStream.schema(rows.schema).parquet(folder)

    def deliver(self, slot: int) -> None:
        bounds = [None, *self.cuts, None][slot:slot + 2]
        for folder, (rows, time) in self.feeds.items():
            low, high = bounds
            if low:
                rows = rows.where(F.col(time) >= F.lit(low).cast("timestamp"))
            if high:
                rows = rows.where(F.col(time) < F.lit(high).cast("timestamp"))
            rows.write.mode("append").parquet(folder)

    def take_back(self) -> None:
        """Remove what was delivered; the query that read it has ended and knows its files."""
        for folder in self.feeds:
            remove(self.spark, folder, keep=True)

    def run(self, out: DataFrame, write, mode: str = "append") -> list[str]:
        """Deliver every slot and run the query to the end of each; the ids of the runs.

        A slot's files and shuffles are gone before the next one.
        """
        ended = []
        for slot in range(len(self.cuts) + 1):
            self.deliver(slot)
            query = jobs.start(out, self.name, write, mode=mode,
                               trigger=jobs.ALL_AVAILABLE, checkpoint=self.checkpoint)
            query.awaitTermination()
            ended.append(query.runId)
            del query  # its plan holds the shuffles
            self.take_back()
            release(self.spark)
        return ended


def _event_feed(replay: Replay, sf_dir: str) -> DataFrame:
    events = inputs.table(replay.spark, sf_dir, "events")
    return replay.feed(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts")


def stream_alert_replay(spark, sf_dir):
    """Alerts upserted by document id while the feed is delivered in slots."""
    replay = Replay(spark, "alert-replay", EVENT_CUTS)
    events = _event_feed(replay, sf_dir).select(*inputs.coupon_columns())
    steps = step_members(events, batch.DAY_RULE, lateness=f"{LATENESS_HOURS} hours")
    replay.run(steps, alert_writer(f"{replay.place}/table", batch.DAY_RULE))
    return read_alerts(spark, f"{replay.place}/table")


def _expiring_sales(spark, sf_dir) -> tuple[Replay, DataFrame]:
    """The two-stream join under a lateness far below the span of the feeds."""
    replay = Replay(spark, "expiring-sales", SALE_CUTS)
    orders = inputs.table(spark, sf_dir, "orders").select(*inputs.order_columns())
    details = inputs.table(spark, sf_dir, "lineitem").select(*inputs.detail_columns())
    orders = orders.withColumn("order_time", F.col("order_time").cast("timestamp"))
    details = details.withColumn("detail_time", F.col("detail_time").cast("timestamp"))
    packs = 16 + (orders.count() + details.count()) // PACK_ROWS
    sales = join_streams(
        replay.feed(orders, "order_time"), replay.feed(details, "detail_time"),
        ttl=SALE_TTL, lateness=SALE_LATENESS, drop_copies=False, packs=packs)
    with settings(spark, SLOT_STATE):
        replay.run(sales, jobs.table_writer(f"{replay.place}/table"))
    return replay, sales


def stream_sale_expiry(spark, sf_dir):
    """Every pair of the batch join, though most of both sides has left the state."""
    replay, sales = _expiring_sales(spark, sf_dir)
    rows = read_table(spark, f"{replay.place}/table", sales.schema)
    return rows.drop(WRITTEN, WRITER, BATCH)


def stream_sale_state(spark, sf_dir):
    """What the join still holds after the last slot, read back from its state."""
    replay, _ = _expiring_sales(spark, sf_dir)
    return held_times(spark, replay.checkpoint).groupBy("side").agg(
        F.count("*").alias("rows"), F.date_format(F.min("time"), "yyyy-MM-dd").alias("oldest"))


def stream_batch_counts(spark, sf_dir):
    """Records in and first records out of every micro-batch with records."""
    replay = Replay(spark, "batch-counts", EVENT_CUTS)
    log = _event_feed(replay, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd").alias("log_date"), "ts", "user_id", "event_id", "event_type")
    first = jobs.counted(
        first_seen_stream(jobs.counted(log, "log_records"), ["log_date", "user_id"], "ts"),
        "first_records")
    counts = metrics.BatchCounts(spark, f"{replay.place}/counts")
    spark.streams.addListener(counts)
    try:
        for run_id in replay.run(first, jobs.table_writer(f"{replay.place}/table"), "update"):
            counts.wait(run_id)
    finally:
        spark.streams.removeListener(counts)
    return metrics.batch_counts(spark, f"{replay.place}/counts").select("nth", "name", "records")


def stream_dau_hours(spark, sf_dir):
    """Active devices per hour from the small table kept beside the detail.

    Each batch is handed in twice, as a retry does.
    """
    replay = Replay(spark, "dau-hours", EVENT_CUTS)
    log = times.with_log_time(
        _event_feed(replay, sf_dir).select("ts", "user_id", "event_id", "event_type"),
        F.col("ts"), "log_date", "log_hour")
    first = first_seen_stream(log, ["log_date", "user_id"], "ts")
    hours = f"{replay.place}/hours"
    write = with_hours(jobs.table_writer(f"{replay.place}/table", ["log_date"]), hours,
                       "log_date", "log_hour")

    def write_twice(rows: DataFrame, batch_id: int) -> None:
        staged = f"{replay.place}/staged/{batch_id}"
        rows.write.mode("overwrite").parquet(staged)
        for _ in range(2):
            write(spark.read.schema(rows.schema).parquet(staged), batch_id)

    replay.run(first, write_twice, "update")
    return read_hours(spark, hours).select(
        F.col("day").alias("log_date"), F.col("hour").alias("log_hour"), F.col("records").alias("dau"))


def stream_amount_hours(spark, sf_dir):
    """Order amounts per hour, kept by the stream that stores the orders."""
    replay = Replay(spark, "amount-hours", EVENT_CUTS)
    bought = _event_feed(replay, sf_dir).where(F.col("event_type") == "purchase").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("create_date"),
        F.date_format("ts", "HH").alias("create_hour"), F.col("value").alias("total_amount"))
    hours = f"{replay.place}/hours"
    replay.run(bought, with_hours(
        jobs.table_writer(f"{replay.place}/table", ["create_date"]), hours,
        "create_date", "create_hour", "total_amount"))
    return read_hours(spark, hours).select(
        F.col("day").alias("create_date"), F.col("hour").alias("create_hour"), "amount")


def stream_change_order(spark, sf_dir):
    """Updates of users routed to their topic: the place of each in its key's log.

    Within a batch a key's rows must lie in one file, in the order of the feed.
    """
    replay = Replay(spark, "change-order", EVENT_CUTS)
    rows = inputs.table(spark, sf_dir, "events").orderBy("event_id")
    entry = F.to_json(F.struct(
        F.lit("ROWDATA").alias("entry_type"), F.lit("shop").alias("database_name"),
        F.lit("user_info").alias("table_name"), F.lit("UPDATE").alias("event_type"),
        F.array(F.struct(F.create_map(
            F.lit("id"), F.col("user_id").cast("string"),
            F.lit("event_id"), F.col("event_id").cast("string")).alias("after"))).alias("row_datas")))
    lines = replay.feed(rows.select(
        entry.alias("value"), F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("ts")), "ts")
    path = f"{replay.place}/topics"
    for slot in range(len(EVENT_CUTS) + 1):
        replay.deliver(slot)
        jobs.change_router_job(
            lines, path, topics=Topics(user="people"), name=replay.name,
            trigger=jobs.ALL_AVAILABLE, checkpoint=replay.checkpoint).awaitTermination()
    log = read_table(spark, path).select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    order = Window.partitionBy("topic", "key").orderBy(BATCH, "file", "at")
    return log.select(
        "topic", "key", F.row_number().over(order).alias("nth"),
        F.get_json_object("value", "$.event_id").alias("event_id"))


LATE_WAIT, LATE_REACH = "400 days", "2000 days"


def stream_late_users(spark, sf_dir):
    """Orders with their buyers, whose rows come before, after or never."""
    replay = Replay(spark, "late-users", SALE_CUTS)
    orders = inputs.table(spark, sf_dir, "orders").select(*inputs.order_columns()).select(
        F.col("id").alias("order_detail_id"), F.col("id").alias("order_id"), "order_status",
        "create_time", "user_id", F.col("id").alias("sku_id"), F.col("total_amount").alias("sku_price"),
        F.col("order_status").alias("sku_name"), F.col("create_date").alias("dt"),
        F.col("order_time").cast("timestamp").alias("sale_time"))
    came = F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(F.col("id") * 37, F.lit(2400)).cast("int"))
    users = inputs.users(spark, sf_dir).withColumn("user_time", came.cast("timestamp"))
    met = join_late_users(
        replay.feed(orders, "sale_time"), replay.feed(users, "user_time"),
        wait=LATE_WAIT, reach=LATE_REACH, lateness=SALE_LATENESS, as_of=batch.AS_OF)
    replay.run(met, jobs.table_writer(f"{replay.place}/table"))
    return read_table(spark, f"{replay.place}/table", met.schema).select(
        "order_id", "user_id", "user_gender", "user_age", "user_level", "dt")


QUERIES = {
    q.__name__: q
    for q in (
        stream_first_seen, stream_sale_detail, stream_latest_user, stream_coupon_alert,
        stream_alert_members, stream_alert_replay, stream_sale_expiry, stream_sale_state,
        stream_batch_counts, stream_dau_hours, stream_amount_hours, stream_change_order,
        stream_late_users,
    )
}
