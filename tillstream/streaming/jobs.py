"""The streaming jobs: source lines to stored tables.

Each function starts one query and returns it.  A failed write fails the batch,
which is then retried from the checkpoint; the tables make such a retry
harmless.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillstream import schemas
from tillstream.functions import records, times
from tillstream.functions.text import upper_names
from tillstream.operators.alerts import AlertRule
from tillstream.operators.orders import prepare_orders
from tillstream.operators.routing import Topics, in_key_order, route_changes, route_logs
from tillstream.operators.sales import enrich_users
from tillstream.session import checkpoint_root, state_settings
from tillstream.sources.changefeed import change_rows, parse_entries
from tillstream.sources.keyed import KeyedTable, keyed_writer
from tillstream.sources.tables import write_batch
from tillstream.streaming.alerts import alert_writer, step_members
from tillstream.streaming.dedup import first_seen_stream
from tillstream.streaming.hours import with_hours
from tillstream.streaming.sales import join_streams

EVERY_5_SECONDS = {"processingTime": "5 seconds"}
ALL_AVAILABLE = {"availableNow": True}

BatchWriter = Callable[[DataFrame, int], None]


def start(
    rows: DataFrame,
    name: str,
    write: BatchWriter,
    mode: str = "append",
    trigger: dict | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Start a query that hands its batches to ``write``."""
    place = checkpoint or f"{checkpoint_root(rows.sparkSession)}/streams/{name}"
    stream = (
        rows.writeStream.queryName(name).outputMode(mode)
        .option("checkpointLocation", place)
        .trigger(**(trigger or EVERY_5_SECONDS))
        .foreachBatch(write)
    )
    with state_settings(rows.sparkSession):
        return stream.start()


def counted(rows: DataFrame, name: str) -> DataFrame:
    """Attach a record count per batch, read from the query's progress."""
    return rows.observe(name, F.count(F.lit(1)).alias("records"))


def table_writer(
    path: str, partition_by: Sequence[str] = (), upper: bool = False
) -> BatchWriter:
    """Batch writer for ``sources.tables``; ``upper`` stores upper-case names."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = upper_names(batch) if upper else batch
        parts = [p.upper() for p in partition_by] if upper else partition_by
        write_batch(rows, path, batch_id, parts)

    return write


def _with_quarantine(write: BatchWriter, quarantine: str | None) -> BatchWriter:
    """Split a parsed batch: good rows to ``write``, bad lines to the quarantine.

    The batch is kept while both outputs read it.
    """

    def write_both(batch: DataFrame, batch_id: int) -> None:
        if not quarantine:
            write(records.good_rows(batch), batch_id)
            return
        batch.persist()
        try:
            write(records.good_rows(batch), batch_id)
            write_batch(records.bad_rows(batch), quarantine, batch_id)
        finally:
            batch.unpersist()

    return write_both


def quarantine_job(
    lines: DataFrame, schema: T.StructType, required: Iterable[str], path: str,
    name: str = "quarantine", **run,
) -> StreamingQuery:
    """Bad lines of a feed whose good rows go through a stateful job."""
    bad = records.bad_rows(records.parse_lines(lines, schema, required))
    return start(bad, name, table_writer(path), **run)


def parse_logs(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """App logs; a line without device or with a time outside all years is bad."""
    parsed = records.parse_lines(lines, schema, ("mid", "ts"))
    return records.flag(parsed, ~times.usable_millis("ts"))


def quarantine_beside(
    parsed: DataFrame, path: str | None, name: str, run: dict
) -> StreamingQuery | None:
    """A second query for the bad lines of a feed whose good rows keep state.

    It reads the feed with a checkpoint of its own, beside the main one.
    """
    if not path:
        return None
    own = {**run, "checkpoint": f"{run['checkpoint']}-bad" if run.get("checkpoint") else None}
    return start(records.bad_rows(parsed), f"{name}_bad", table_writer(path), **own)


def startup_rows(lines: DataFrame) -> DataFrame:
    """Good startup logs with date, hour and event time."""
    rows = records.good_rows(parse_logs(lines, schemas.STARTUP_LOG)).withColumn("event_time", times.from_millis("ts"))
    return times.with_log_time(rows, F.col("event_time"))


def active_device_job(
    lines: DataFrame, path: str, keep: str = "2 days", upper: bool = False,
    quarantine: str | None = None, name: str = "active_devices", hours: str | None = None, **run,
) -> StreamingQuery:
    """Startup logs to the table of first starts per device and day.

    With ``hours`` the number of devices per day and hour is kept there.
    ``upper`` stores the columns under upper-case names.  With ``quarantine`` a
    second query, ``<name>_bad``, stores the bad lines.
    """
    quarantine_beside(parse_logs(lines, schemas.STARTUP_LOG), quarantine, name, run)
    rows = counted(startup_rows(lines), "startup_records")
    rows = rows.select(*schemas.DAU_COLUMNS, "event_time")
    first = counted(
        first_seen_stream(rows, ["logDate", "mid"], "event_time", keep), "new_records"
    )
    write = table_writer(path, ["logDate"], upper)
    if hours:
        write = with_hours(write, hours, "logDate", "logHour")
    return start(first.select(*schemas.DAU_COLUMNS), name, write, mode="update", **run)


def order_job(
    lines: DataFrame, path: str, quarantine: str | None = None, name: str = "orders",
    hours: str | None = None, **run,
) -> StreamingQuery:
    """Order rows, masked and dated, to the order table.

    With ``hours`` the number and amount of deliveries per day and hour is kept there.
    Read it with ``read_latest(..., ["id"])`` for one row per order, or with
    ``read_table`` for every delivery.
    """
    parsed = records.parse_lines(lines, schemas.ORDER_INFO, ("id", "create_time"))
    ready = prepare_orders(parsed).select(
        *schemas.ORDER_COLUMNS, records.BAD, records.RAW
    )
    store = table_writer(path, ["create_date"])
    if hours:
        store = with_hours(store, hours, "create_date", "create_hour", "total_amount")
    write = _with_quarantine(store, quarantine)
    return start(counted(ready, "order_records"), name, write, **run)


def feed_place(lines: DataFrame) -> list[str]:
    """The columns that tell where a line stands in its feed."""
    return [c for c in ("offset", "ingest_time", "file_block") if c in lines.columns]


def with_seq(batch: DataFrame, place: Sequence[str]) -> DataFrame:
    """Rows of a batch with ``seq``, their order in the feed, for their place in it.

    That is the offset, or the time and block of the file; rows of one line or
    block keep the order that they have in a partition of the batch.
    """
    row = F.monotonically_increasing_id()
    parts = [F.unix_micros(c) if c == "ingest_time" else F.col(c).cast("bigint") for c in place]
    if "offset" in place:
        parts = [F.col("offset").cast("bigint")]
    return batch.withColumn("seq", F.array(*parts, row)).drop(*place)


def user_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """Current users by id, for ``user_job`` and ``sale_job``."""
    schema = T.StructType([*schemas.USER_INFO, T.StructField("seq", T.ArrayType(T.LongType()))])
    return KeyedTable(spark, path, schema, ("id",), ("seq",), buckets)


def user_job(
    lines: DataFrame, path: str, quarantine: str | None = None, name: str = "users",
    table: KeyedTable | None = None, **run,
) -> StreamingQuery:
    """User inserts and updates to the user table; the last write wins.

    With ``table`` (see ``user_table``) they are upserted there, in the buckets
    of their keys; otherwise every write is kept under ``path``.

    The order of arrival is the ``seq`` column, an array: the Kafka offset
    (updates of one user share a partition), or the file's time, block and line.
    Read the table with ``read_latest(..., ["id"], ["seq"])``.
    """
    names = [f.name for f in schemas.USER_INFO]
    place = feed_place(lines)
    parsed = records.parse_lines(lines, schemas.USER_INFO, ("id",)).select(
        *names, *place, records.BAD, records.RAW)
    store = keyed_writer(table, name) if table is not None else table_writer(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(with_seq(batch, place), batch_id)

    return start(parsed, name, _with_quarantine(write, quarantine), **run)


def sale_job(
    order_lines: DataFrame,
    detail_lines: DataFrame,
    users: Callable[[], DataFrame] | KeyedTable,
    path: str,
    as_of: str | None = None,
    ttl: str = "100 seconds",
    lateness: str = "10 seconds",
    salts: int = 1,
    quarantine: str | None = None,
    name: str = "sales",
    **run,
) -> StreamingQuery:
    """Join both feeds by arrival time, add the buyer, store by day.

    ``users`` is called per batch, so updates of the user table are seen; of a
    keyed table only the buckets of a batch's buyers are read.  With
    ``quarantine`` second queries store the bad lines of both feeds.
    """
    orders = prepare_orders(
        records.parse_lines(order_lines, schemas.ORDER_INFO, ("id", "create_time"))
    )
    details = records.parse_lines(detail_lines, schemas.ORDER_DETAIL, ("id", "order_id"))
    for feed, parsed in (("orders", orders), ("details", details)):
        quarantine_beside(parsed, quarantine, f"{name}_{feed}", {
            **run, "checkpoint": f"{run['checkpoint']}-{feed}" if run.get("checkpoint") else None})
    sales = join_streams(
        records.good_rows(orders).withColumnRenamed("ingest_time", "order_time"),
        records.good_rows(details).withColumnRenamed("ingest_time", "detail_time"),
        ttl=ttl, lateness=lateness, salts=salts,
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if isinstance(users, KeyedTable):
                known = users.lookup(batch.select(F.col("user_id").alias("id")))
            else:
                known = users()
            write_batch(enrich_users(batch, known, as_of), path, batch_id, ["dt"])
        finally:
            batch.unpersist()

    return start(sales, name, write, **run)


def event_rows(lines: DataFrame) -> DataFrame:
    """Good event logs with date, hour and event time."""
    rows = records.good_rows(parse_logs(lines, schemas.EVENT_LOG)).withColumn("event_time", times.from_millis("ts"))
    return times.with_log_time(rows, F.col("event_time"))


def alert_job(
    lines: DataFrame, path: str, rule: AlertRule = AlertRule(),
    lateness: str = "10 seconds", quarantine: str | None = None,
    name: str = "coupon_alerts", **run,
) -> StreamingQuery:
    """Event logs to alerts with their lists, under ``path``.

    Read them with ``streaming.alerts.read_alerts`` and ``read_members``.
    With ``quarantine`` a second query, ``<name>_bad``, stores the bad lines.
    """
    quarantine_beside(parse_logs(lines, schemas.EVENT_LOG), quarantine, name, run)
    steps = step_members(event_rows(lines), rule, lateness)
    return start(steps, name, alert_writer(path, rule), **run)


def _topic_writer(
    kafka: dict[str, str] | None, path: str | None, quarantine: str | None,
    place: Sequence[str],
) -> BatchWriter:
    """Routed rows to their topics, lines without a topic to the quarantine.

    The rows of a key keep the order of the feed: they are produced by one task,
    or lie in one file a batch, sorted by ``seq``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = with_seq(batch, place).persist()
        try:
            routed = batch.where(F.col("topic").isNotNull())
            if kafka:
                rows = in_key_order(routed, ["seq"]).select("topic", "key", "value")
                rows.write.format("kafka").options(**kafka).save()
            else:
                write_batch(routed, path, batch_id, ["topic"], key="key", order=["seq"])
            if quarantine:
                lost = batch.where(F.col("topic").isNull()).select("value")
                write_batch(lost, quarantine, batch_id)
        finally:
            batch.unpersist()

    return write


def log_router_job(
    lines: DataFrame, path: str | None = None, kafka: dict[str, str] | None = None,
    topics: Topics = Topics(), quarantine: str | None = None, name: str = "log_router", **run,
) -> StreamingQuery:
    """Stamp and route raw logs, to Kafka or to a folder per topic; lines that
    are not JSON objects go to ``quarantine``."""
    place = feed_place(lines)
    routed = route_logs(lines, topics=topics, carry=place)
    return start(routed, name, _topic_writer(kafka, path, quarantine, place), **run)


def change_router_job(
    lines: DataFrame, path: str | None = None, kafka: dict[str, str] | None = None,
    topics: Topics = Topics(), database: str | None = None, quarantine: str | None = None,
    name: str = "change_router", **run,
) -> StreamingQuery:
    """Route database changes, to Kafka or to a folder per topic.

    With ``database`` only its tables count; lines that are not change entries
    go to ``quarantine``.
    """
    place = feed_place(lines)
    entry = F.from_json("value", schemas.CHANGE_ENTRY)
    parsed = lines.select("value", (
        entry.isNull() | entry["entry_type"].isNull()).alias("_lost"), *place)
    entries = parse_entries(parsed.where(~F.col("_lost")), carry=place)
    routed = route_changes(change_rows(entries, database, place), topics, carry=place)
    lost = parsed.where(F.col("_lost")).select(
        F.lit(None).cast("string").alias("topic"), F.lit(None).cast("string").alias("key"),
        "value", *place)
    return start(
        routed.unionByName(lost), name, _topic_writer(kafka, path, quarantine, place), **run)


def console_job(rows: DataFrame, n: int, name: str = "console", **run) -> StreamingQuery:
    """Print ``n`` rows of every batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.show(n, truncate=False)

    return start(rows, name, write, **run)
