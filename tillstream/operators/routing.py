"""Log and change-row routing to topics.

Output rows are ``topic, key, value``: ready for a Kafka sink, or for a file
sink partitioned by topic.  The key is the entity id, which keeps the updates
of one entity in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Topic names, and the tables and statement kinds of the feed.
@dataclass(frozen=True)
class Topics:
    startup: str = "startup_log"
    event: str = "event_log"
    order: str = "order_info"
    detail: str = "order_detail"
    user: str = "user_info"


# (table, accepted statement kinds, Topics field)
CHANGE_RULES = (
    ("order_info", ("INSERT",), "order"),
    ("order_detail", ("INSERT",), "detail"),
    ("user_info", ("INSERT", "UPDATE"), "user"),
)


def log_topic(kind: Column, topics: Topics = Topics(), startup: str = "startup") -> Column:
    """Startup logs to one topic; every other kind, also NULL, to the event topic."""
    return F.when(kind == startup, topics.startup).otherwise(topics.event)


def route_logs(
    lines: DataFrame,
    clock: Column | None = None,
    topics: Topics = Topics(),
    value: str = "value",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Stamp each JSON log with the arrival time and choose its topic.

    ``ts`` of the client is replaced by a number, all other values keep their
    types.  A repeated key counts with its last value where the session allows
    repeated keys; otherwise, and for lines that are not JSON objects, the
    topic is NULL and the line stays as it came.
    """
    now = F.unix_millis(F.current_timestamp()) if clock is None else clock
    body = F.try_variant_get(F.try_parse_json(F.col(value)), "$", "map<string,variant>")
    rows = lines.select(
        F.map_filter(body, lambda k, _: k != "ts").alias("_body"),
        F.parse_json(now.cast("string")).alias("_ts"),
        F.col(value).alias("_raw"), *carry,
    )
    stamped = F.to_json(F.map_concat("_body", F.create_map(F.lit("ts"), F.col("_ts"))))

    def text(key: str) -> Column:
        return F.try_variant_get(F.col("_body")[key], "$", "string")

    return rows.select(
        F.when(F.col("_body").isNotNull(), log_topic(text("type"), topics)).alias("topic"),
        text("mid").alias("key"),
        F.coalesce(stamped, F.col("_raw")).alias("value"), *carry,
    )


def change_topic(table: Column, event: Column, topics: Topics = Topics()) -> Column:
    """Topic of a change row, NULL when no rule takes it."""
    chain = F.lit(None).cast("string")
    for name, kinds, field in reversed(CHANGE_RULES):
        chain = F.when(
            (table == name) & event.isin(*kinds), getattr(topics, field)
        ).otherwise(chain)
    return chain


def route_changes(
    changes: DataFrame, topics: Topics = Topics(), key: str = "id", carry: Sequence[str] = ()
) -> DataFrame:
    """Keep the change rows some topic wants, as JSON of their after-image."""
    return changes.select(
        change_topic(F.col("table_name"), F.col("event_type"), topics).alias("topic"),
        F.col("after")[key].alias("key"),
        F.to_json("after").alias("value"), *carry,
    ).where(F.col("topic").isNotNull())


def in_key_order(routed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of one topic and key in one task, in the order of the feed.

    A producer sends the rows of a task one after the other, so a key's rows
    arrive in that order.  Order is per key: a key is never in two tasks.
    """
    return routed.repartition("topic", "key").sortWithinPartitions("topic", "key", *order)
