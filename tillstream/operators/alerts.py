"""Coupon-abuse alerts over sliding windows.

A device raises an alert in a window when at least ``min_users`` different
users took coupons on it and nobody clicked an item.  Windows overlap heavily
(60 per record at five minutes by five seconds), so records are not copied
into their windows.  Instead each record is reduced to the slide step it falls
in, and the windows it belongs to become an interval of window ends.  Interval
starts and ends are summed per device and boundary, and running sums over the
boundaries give the exact counts of every window.

Sizes: after the first aggregation a device holds at most one row per step per
member, and at most two boundary rows per step, however many records it had.
Running sums restart in every time block, so the largest group is a block's
boundaries, whatever the time range.  No list of a device's records is built.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillstream.functions.times import millis


@dataclass(frozen=True)
class AlertRule:
    """Column names, literals and window sizes (milliseconds)."""

    device: str = "mid"
    user: str = "uid"
    item: str = "itemid"
    event: str = "evid"
    ts: str = "event_time"
    coupon: str = "coupon"
    click: str = "clickItem"
    min_users: int = 3
    window_ms: int = 300_000
    slide_ms: int = 5_000
    grain_ms: int = 60_000

    def __post_init__(self):
        for name in ("window_ms", "grain_ms"):
            if getattr(self, name) % self.slide_ms:
                raise ValueError(f"{name} must be a multiple of slide_ms")

    @property
    def block_ms(self) -> int:
        """Time span counted as one unit; whole windows and whole minutes."""
        return 64 * math.lcm(self.window_ms, self.grain_ms)


def _div(value: Column, by: int) -> Column:
    """Whole division of non-negative milliseconds (exact below 2**53)."""
    return F.floor(value / F.lit(by)).cast("bigint")


def _steps(events: DataFrame, rule: AlertRule) -> DataFrame:
    """Records with ``_at``: the end of the first window that holds them.

    Records without a device or a time belong to no alert and are left out.
    """
    at = (_div(millis(rule.ts), rule.slide_ms) + 1) * rule.slide_ms
    known = F.col(rule.device).isNotNull() & F.col(rule.ts).isNotNull()
    return events.where(known).select(
        F.col(rule.device).cast("string").alias("mid"),
        F.col(rule.user).cast("string").alias("uid"),
        F.col(rule.item).cast("string").alias("itemid"),
        F.col(rule.event).alias("evid"),
        at.alias("_at"),
    )


def member_spans(events: DataFrame, rule: AlertRule) -> DataFrame:
    """When each coupon user and item counts: ``mid, kind, member, start, end``.

    ``start`` and ``end`` bound the window ends (half open).  Overlapping
    coverage of one member is merged, so a member counts once per window.
    NULL users and items are not members.
    """
    members = F.inline(F.array(
        F.struct(F.lit("user").alias("kind"), F.col("uid").alias("member")),
        F.struct(F.lit("item").alias("kind"), F.col("itemid").alias("member")),
    ))
    taken = (
        _steps(events.where(F.col(rule.event) == rule.coupon), rule)
        .select("mid", F.col("_at").alias("at"), members)
        .where(F.col("member").isNotNull())
        .distinct()
    )
    return merged_spans(taken, rule)


def merged_spans(taken: DataFrame, rule: AlertRule) -> DataFrame:
    """Coverage of ``mid, kind, member, at`` (steps in milliseconds), merged.

    Coverage is cut at block borders before merging, so one group holds the
    steps of one member in one block, however long the time range is.
    """
    spans = _in_blocks(
        taken.withColumns({"start": F.col("at"), "end": F.col("at") + rule.window_ms}), rule)
    gap = F.concat((F.col("end") - F.col("start")).cast("string"), F.lit(" milliseconds"))
    span = F.session_window(F.timestamp_millis("start"), gap)
    return (
        spans.groupBy("mid", "kind", "member", "block", span.alias("span"))
        .agg(F.count("*").alias("steps"))
        .select(
            "mid", "kind", "member",
            F.unix_millis("span.start").alias("start"),
            F.unix_millis("span.end").alias("end"),
        )
    )


def event_tallies(
    events: DataFrame, rule: AlertRule, listing: bool = True
) -> DataFrame:
    """Event ids with repeats: ``mid, member, start, end, n`` per slide step.

    Without ``listing`` only clicks are told apart, which is enough to count.
    """
    evid = F.col("evid")
    member = evid if listing else F.when(evid == rule.click, evid)
    return (
        _steps(events, rule)
        .groupBy("mid", member.alias("member"), F.col("_at").alias("start"))
        .agg(F.count("*").alias("n"))
        .withColumn("end", F.col("start") + rule.window_ms)
    )


def alert_pieces(events: DataFrame, rule: AlertRule = AlertRule()) -> DataFrame:
    """Everything alerts are made of: ``mid, kind, member, start, end, n``.

    Kinds are ``user`` and ``item`` (merged coverage, ``n`` = 1) and ``event``
    (``n`` repeats in one step).  Counting and listing both start from here,
    so a query that does both computes them once.
    """
    pieces = (
        member_spans(events, rule).withColumn("n", F.lit(1).cast("bigint"))
        .unionByName(event_tallies(events, rule).withColumn("kind", F.lit("event")))
    )
    # The conditions any later join infers, stated here for every consumer:
    # equal subplans let Spark reuse the shuffles instead of repeating them.
    for name in ("mid", "start", "end"):
        pieces = pieces.where(F.col(name).isNotNull())
    return pieces


def _boundary(at: str, sign: int, counts: dict[str, Column]) -> Column:
    fields = [F.col(at).alias("at")]
    fields += [(value * F.lit(sign)).alias(name) for name, value in counts.items()]
    return F.struct(*fields)


def _in_blocks(pieces: DataFrame, rule: AlertRule) -> DataFrame:
    """Intervals cut at block borders, with their ``block``."""
    size = rule.block_ms
    blocks = F.sequence(_div(F.col("start"), size), _div(F.col("end") - 1, size))
    # Never NULL; the outer form only keeps the optimizer from adding filters.
    return pieces.select("*", F.explode_outer(blocks).alias("block")).withColumns({
        "start": F.greatest("start", F.col("block") * size),
        "end": F.least("end", (F.col("block") + 1) * size),
    })


def window_counts(pieces: DataFrame, rule: AlertRule) -> DataFrame:
    """Counts of every window as runs of equal windows.

    ``mid, block, at, next_at, users, items, events, clicks``: each window of
    the device that ends in ``[at, next_at)`` has these counts.
    """

    def of(kind: str, also: Column | None = None) -> Column:
        test = F.col("kind") == kind
        return F.when(test if also is None else test & also, F.col("n")).otherwise(0)

    counts = {
        "users": of("user"),
        "items": of("item"),
        "events": of("event"),
        "clicks": of("event", F.col("member") == rule.click),
    }
    # Counts are added where an interval starts and taken off where it ends.
    edges = _in_blocks(pieces, rule).select("mid", "block", F.inline(F.array(
        _boundary("start", 1, counts), _boundary("end", -1, counts)
    )))
    steps = edges.groupBy("mid", "block", "at").agg(*[F.sum(n).alias(n) for n in counts])
    in_order = Window.partitionBy("mid", "block").orderBy("at")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select(
        "mid", "block", "at", F.lead("at").over(in_order).alias("next_at"),
        *[F.sum(n).over(so_far).alias(n) for n in counts],
    )


def coupon_alerts(events: DataFrame, rule: AlertRule = AlertRule()) -> DataFrame:
    """One alert per device and minute (``grain_ms``): that of its last window.

    ``doc_id, alert_date, mid, window_end, users, items, events``;
    ``window_end`` is in epoch milliseconds.
    """
    pieces = member_spans(events, rule).withColumn("n", F.lit(1).cast("bigint"))
    tallies = event_tallies(events, rule, listing=False)
    return alerts_from(
        pieces.unionByName(tallies.withColumn("kind", F.lit("event"))), rule
    )


def alerts_from(pieces: DataFrame, rule: AlertRule = AlertRule()) -> DataFrame:
    """``coupon_alerts`` over prepared pieces."""
    grain, slide = rule.grain_ms, rule.slide_ms
    runs = window_counts(pieces, rule).where(
        (F.col("users") >= rule.min_users) & (F.col("clicks") == 0)
        & (F.col("next_at") > F.col("at"))
    )
    last = F.col("next_at") - slide
    slots = F.explode(F.sequence(_div(F.col("at"), grain), _div(last, grain)))
    in_slot = runs.select("*", slots.alias("slot")).select(
        "mid", "block", "slot", "users", "items", "events",
        F.least(last, (F.col("slot") + 1) * grain - slide).alias("window_end"),
    )
    best = F.max(F.struct("window_end", "users", "items", "events")).alias("a")
    return (
        # A slot lies in one block; naming it keeps the partitioning in use.
        in_slot.groupBy("mid", "block", "slot").agg(best)
        .select(
            alert_id("mid", F.col("a.window_end"), grain).alias("doc_id"),
            alert_day(F.col("a.window_end")).alias("alert_date"),
            "mid", "a.*",
        )
    )


def alert_id(device: str, end_ms: Column, grain_ms: int = 60_000) -> Column:
    """``device-minute`` with the minute counted from the epoch."""
    return F.concat_ws("-", F.col(device), _div(end_ms, grain_ms).cast("string"))


def alert_day(end_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(end_ms), "yyyy-MM-dd")


def _listed(alerts: DataFrame, pieces: DataFrame, rule: AlertRule) -> DataFrame:
    """Alert columns with ``kind, member, n`` for everything an alert lists.

    Alerts and intervals meet on device and time slot of one window length, so
    only pairs at most two windows apart are compared.
    """
    length = rule.window_ms
    slots = F.sequence(_div(F.col("start"), length), _div(F.col("end") - 1, length))
    # Never NULL; the outer form only keeps the optimizer from adding filters.
    spread = pieces.select("*", F.explode_outer(slots).alias("_slot"))
    wanted = alerts.withColumn("_slot", _div(F.col("window_end"), length))
    covered = (F.col("window_end") >= F.col("start")) & (F.col("window_end") < F.col("end"))
    return (
        wanted.join(spread, ["mid", "_slot"]).where(covered)
        .groupBy(*alerts.columns, "kind", "member")
        .agg(F.sum("n").alias("n"))
    )


def alert_members(
    alerts: DataFrame, pieces: DataFrame, rule: AlertRule = AlertRule()
) -> DataFrame:
    """What each alert lists: ``doc_id, alert_date, kind, member, n``.

    Kinds are ``user`` and ``item`` (sets, ``n`` = 1) and ``event`` (all event
    ids of the window with their number of repeats).
    """
    keys = alerts.select("doc_id", "alert_date", "mid", "window_end")
    return _listed(keys, pieces, rule).select("doc_id", "alert_date", "kind", "member", "n")


def alert_documents(
    alerts: DataFrame, pieces: DataFrame, rule: AlertRule = AlertRule(),
    part_size: int = 10_000,
) -> DataFrame:
    """Alerts with their lists as arrays, cut into parts of about ``part_size``.

    Almost every alert is one part.  One with very many users, items or event
    ids becomes several rows (``part`` 0..``parts``-1) rather than unbounded
    arrays; together they hold every member.  The key is ``(doc_id, part)``.
    """
    listed = _listed(alerts, pieces, rule)
    sizes = listed.groupBy("doc_id").agg(
        F.ceil(F.count("*") / F.lit(part_size)).cast("bigint").alias("parts"))
    listed = listed.join(sizes, "doc_id").withColumn(
        "part", F.pmod(F.xxhash64("kind", "member"), F.col("parts"))
    )

    def pick(kind: str) -> Column:
        return F.sort_array(
            F.collect_list(F.when(F.col("kind") == kind, F.col("member")))
        )

    repeats = F.when(
        F.col("kind") == "event", F.struct(F.col("member").alias("evid"), "n")
    )
    return listed.groupBy(*alerts.columns, "parts", "part").agg(
        pick("user").alias("uids"),
        pick("item").alias("itemIds"),
        F.sort_array(F.collect_list(repeats)).alias("event_counts"),
    )
