"""Alert windows against a naive count of every window."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillstream.operators import alerts
from tillstream.operators.alerts import AlertRule

RULE = AlertRule(window_ms=60_000, slide_ms=5_000, grain_ms=20_000)
SCHEMA = "mid string, uid string, evid string, itemid string, t long"


def sample(seed, n=400, devices=4, span_ms=600_000):
    r = random.Random(seed)
    kinds = ["coupon"] * 6 + ["addCart"] * 3 + ["clickItem"]
    return [
        (
            f"m{min(r.randrange(devices * 2), devices - 1)}",
            r.choice([None] + [f"u{i}" for i in range(5)]),
            r.choice(kinds + [None]),
            r.choice([None, "i1", "i2", "i3"]),
            1_610_000_000_000 + r.randrange(span_ms) // r.choice([1, 1000]) * r.choice([1, 1000]) % span_ms,
        )
        for _ in range(n)
    ]


def naive(rows, rule):
    """alert id -> (window_end, users, items, event bag), window by window."""
    held = defaultdict(list)
    for mid, uid, evid, item, t in rows:
        first = (t // rule.slide_ms + 1) * rule.slide_ms
        for end in range(first, first + rule.window_ms, rule.slide_ms):
            held[mid, end].append((uid, evid, item))
    best = {}
    for (mid, end), logs in held.items():
        users = {u for u, e, _ in logs if e == rule.coupon and u is not None}
        items = {i for _, e, i in logs if e == rule.coupon and i is not None}
        if len(users) < rule.min_users or any(e == rule.click for _, e, _ in logs):
            continue
        key = f"{mid}-{end // rule.grain_ms}"
        if key not in best or best[key][0] < end:
            bag = defaultdict(int)
            for _, e, _ in logs:
                bag[e] += 1
            best[key] = (end, users, items, dict(bag))
    return best


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn(
        "event_time", F.timestamp_millis("t")
    )


@pytest.mark.parametrize("seed, n, span_ms", [
    (0, 400, 600_000), (1, 400, 600_000), (2, 60, 600_000),
    # About twenty time blocks, and users that stay across their borders.
    (3, 9000, 80_000_000),
])
def test_alerts_equal_naive_windows(spark, seed, n, span_ms):
    rows = sample(seed, n, span_ms=span_ms)
    want = naive(rows, RULE)
    pieces = alerts.alert_pieces(frame(spark, rows).repartition(3), RULE)
    heads = alerts.alerts_from(pieces, RULE)
    got = {r.doc_id: (r.window_end, r.users, r.items, r.events) for r in heads.collect()}
    assert got == {
        k: (end, len(u), len(i), sum(bag.values())) for k, (end, u, i, bag) in want.items()
    }
    members = defaultdict(dict)
    for r in alerts.alert_members(heads, pieces, RULE).collect():
        members[r.doc_id, r.kind][r.member] = r.n
    for key, (_, users, items, bag) in want.items():
        assert members[key, "user"] == dict.fromkeys(users, 1)
        assert members[key, "item"] == dict.fromkeys(items, 1)
        assert members[key, "event"] == bag
    assert want, "the sample should raise alerts"


def test_documents_in_parts_hold_everything(spark):
    rows = [("m", f"u{i:03d}", "coupon", f"i{i % 7}", 1_610_000_000_000 + i) for i in range(100)]
    pieces = alerts.alert_pieces(frame(spark, rows), RULE)
    heads = alerts.alerts_from(pieces, RULE)
    whole = alerts.alert_documents(heads, pieces, RULE).collect()
    assert {(r.parts, r.part) for r in whole} == {(1, 0)}
    assert all(len(r.uids) == 100 and len(r.itemIds) == 7 for r in whole)
    assert all([tuple(e) for e in r.event_counts] == [("coupon", 100)] for r in whole)

    cut = alerts.alert_documents(heads, pieces, RULE, part_size=20).collect()
    by_doc = defaultdict(list)
    for r in cut:
        by_doc[r.doc_id].extend(r.uids)
        assert r.parts == 6 and 0 <= r.part < 6 and len(r.uids) < 60
    assert len(by_doc) == len(whole)
    for r in whole:
        assert sorted(by_doc[r.doc_id]) == r.uids


def test_hot_device_and_copies(spark):
    """Many copies of one record count as one user and many events."""
    copies = spark.range(30_000).select(
        F.lit("m").alias("mid"), F.lit("u1").alias("uid"), F.lit("coupon").alias("evid"),
        F.lit("i").alias("itemid"), F.lit(1_610_000_000_000).alias("t"),
    )
    others = spark.createDataFrame(
        [("m", u, "coupon", "i", 1_610_000_000_000) for u in ("u2", "u3")], SCHEMA
    )
    df = copies.unionByName(others).withColumn("event_time", F.timestamp_millis("t"))
    got = alerts.coupon_alerts(df, RULE).collect()
    assert {(r.users, r.items, r.events) for r in got} == {(3, 1, 30_002)}


def test_window_sizes_must_fit():
    with pytest.raises(ValueError):
        AlertRule(window_ms=7_000, slide_ms=5_000)
    with pytest.raises(ValueError):
        AlertRule(grain_ms=7_000)
