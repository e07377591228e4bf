"""The join whose state is kept in packs: the rows and the state of Spark's own join."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import finish
from tillstream.plans import stream
from tillstream.sources.tables import read_table
from tillstream.streaming import jobs
from tillstream.streaming.packs import held_times, span_micros
from tillstream.streaming.sales import join_streams

ORDERS = "id long, order_status string, create_time string, user_id long, create_date string, order_time timestamp"
DETAILS = "id string, order_id long, sku_id long, order_price double, sku_name string, detail_time timestamp"
BIG = 2**62 + 1  # no double holds it


def day(n, micros=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n, microseconds=micros)


def order(key, n, user=BIG, status='é "o"\n', micros=0):
    return key, status, "", user, None, day(n, micros)


def detail(name, key, n, sku=7, price=0.1, micros=0):
    return name, key, sku, price, name, day(n, micros)


#: What is delivered to each side, run by run.
RUNS = [
    ([order(1, 0), order(1, 0), order(2, 10, user=None, status=None), order(None, 5)],
     [detail("a", 1, 3), detail("b", 1, 11), detail("c", 2, 5, sku=None, price=None), detail("d", None, 5),
      detail("e", 9, 60), detail("e", 9, 60), detail("f", 3, 58)]),
    # the watermark is at day 5 now: the first order is late, the last two meet what is held
    ([order(8, 3), order(9, 70), order(3, 48, micros=-1)],
     [detail("g", 2, 20), detail("h", 2, 20, micros=1), detail("i", 8, 4), detail("j", BIG, 71)]),
    ([order(BIG, 75), order(7, 200)], [detail("k", 1, 66), detail("l", 7, 202), detail("m", 7, 199)]),
]


def joined(spark, place, packs, salts=1, runs=RUNS):
    """The pairs, and the rows that each side holds after every run."""
    feeds = []
    for name, schema, time in (("o", ORDERS, "order_time"), ("d", DETAILS, "detail_time")):
        spark.createDataFrame([], schema).write.parquet(f"{place}/{name}")
        feeds.append(spark.readStream.schema(schema).parquet(f"{place}/{name}"))
    sales = join_streams(*feeds, ttl="10 days", lateness="5 days", drop_copies=False, salts=salts, packs=packs)
    held = []
    for rows in runs:
        for name, schema, side in zip("od", (ORDERS, DETAILS), rows):
            spark.createDataFrame(side, schema).coalesce(1).write.mode("append").parquet(f"{place}/{name}")
        query = finish(jobs.start(sales, f"packs-{packs}-{salts}", jobs.table_writer(f"{place}/out"),
                                  trigger=jobs.ALL_AVAILABLE, checkpoint=f"{place}/cp"))
        if packs:
            times = held_times(spark, f"{place}/cp")
        else:
            read = spark.read.format("statestore")
            left, right = (read.option("joinSide", s).load(f"{place}/cp") for s in ("left", "right"))
            times = left.select(F.lit("left"), "value.order_time").union(
                right.select(F.lit("right"), "value.detail_time"))
        held.append(sorted(map(tuple, times.collect())))
    pairs = read_table(spark, f"{place}/out", sales.schema).select(*sales.columns)
    return sorted(map(str, pairs.collect())), held, query, sales.schema


@pytest.mark.parametrize("packs", [1, 3])
def test_packs_give_the_rows_and_the_state_of_the_join(spark, tmp_path, packs):
    pairs, held, _, schema = joined(spark, tmp_path / "rows", None)
    found, kept, query, same = joined(spark, tmp_path / "packs", packs)
    assert len(pairs) > 8
    assert found == pairs
    assert kept == held
    assert [(f.name, f.dataType) for f in same] == [(f.name, f.dataType) for f in schema]
    states = [json.loads(p.json)["stateOperators"][0] for p in query.recentProgress]
    assert 0 < max(s["numRowsUpdated"] for s in states) <= packs  # rows of the state: one a pack


def test_packs_with_salts(spark, tmp_path):
    pairs = joined(spark, tmp_path / "rows", None, runs=RUNS[:1])[0]
    assert joined(spark, tmp_path / "packs", 2, salts=3, runs=RUNS[:1])[0] == pairs


def test_a_pack_of_many_rows(spark, tmp_path):
    """More rows of one key than Arrow sends at once, each pair once."""
    n = 25_000
    spark.createDataFrame([order(1, 0)], ORDERS).write.parquet(f"{tmp_path}/o")
    spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.lit(1).cast("long").alias("order_id"),
        F.col("id").alias("sku_id"), F.lit(1.5).alias("order_price"), F.lit("x").alias("sku_name"),
        F.lit(day(1)).cast("timestamp").alias("detail_time")).write.parquet(f"{tmp_path}/d")
    orders, details = (spark.readStream.schema(s).parquet(f"{tmp_path}/{x}") for s, x in ((ORDERS, "o"), (DETAILS, "d")))
    sales = join_streams(orders, details, ttl="10 days", lateness="5 days", drop_copies=False, packs=4)
    finish(jobs.start(sales, "many", jobs.table_writer(f"{tmp_path}/out"),
                      trigger=jobs.ALL_AVAILABLE, checkpoint=f"{tmp_path}/cp"))
    out = read_table(spark, f"{tmp_path}/out", sales.schema)
    assert (out.count(), out.select("sku_id").distinct().count()) == (n, n)
    assert held_times(spark, f"{tmp_path}/cp").groupBy("side").count().orderBy("side").collect() == [
        ("left", 1), ("right", n)]


def test_spans(spark):
    assert span_micros(spark, "100 days") == 100 * 86_400 * 10**6
    with pytest.raises(ValueError):
        span_micros(spark, "1 month")


def tables(spark, place):
    """Seven years of orders and details."""
    spark.sql("""
        select id as o_orderkey, id % 7 as o_custkey, 'F' as o_orderstatus, 1.5D as o_totalprice,
               timestamp_ntz '1995-01-01' + make_dt_interval(cast(id * 5 as int)) as o_orderdate
        from range(480)""").write.parquet(f"{place}/orders.parquet")
    spark.sql("""
        select o.id as l_orderkey, o.id * 3 as l_partkey, 4L as l_suppkey, n as l_linenumber, 2.5D as l_extendedprice,
               'A' as l_returnflag, 'O' as l_linestatus,
               timestamp_ntz '1995-01-01' + make_dt_interval(cast(o.id * 5 + n * 40 as int)) as l_shipdate
        from range(480) o, (select explode(sequence(1, 4)) as n)""").write.parquet(f"{place}/lineitem.parquet")
    return str(place)


def test_a_replay_leaves_little_on_disk(spark, tmp_path, monkeypatch):
    """Delivered files, shuffles and old versions of the state go while the slots go on."""
    seen = []
    take_back = stream.Replay.take_back

    def watch(replay):
        take_back(replay)
        place = Path(replay.place.removeprefix("file:"))
        seen.append((place, sum(1 for f in place.glob("feed-*/*.parquet"))))

    monkeypatch.setattr(stream.Replay, "take_back", watch)
    rows = stream.stream_sale_expiry(spark, tables(spark, tmp_path))
    assert rows.count() == 480 * 2  # 40 and 80 days later; 120 and 160 are too late
    assert [n for _, n in seen] == [0] * 5
    versions = {int(f.stem.split("_")[0]) for f in (seen[0][0] / "checkpoint/state").glob("0/*/*.zip")}
    assert 10 in versions and len(versions) <= 4  # of ten batches
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain", None) is None


def test_what_the_replay_holds_at_its_end(spark, tmp_path):
    found = {r.side: (r.rows, r.oldest) for r in stream.stream_sale_state(spark, tables(spark, tmp_path)).collect()}
    mark = min(dt.date(1995, 1, 1) + dt.timedelta(days=479 * 5), dt.date(1995, 1, 1) + dt.timedelta(days=479 * 5 + 160))
    first = (mark - dt.timedelta(days=130) - dt.date(1995, 1, 1)).days
    left = [i * 5 for i in range(480) if i * 5 >= first]
    right = [i * 5 + n * 40 for i in range(480) for n in range(1, 5) if i * 5 + n * 40 >= first]
    assert found == {side: (len(x), str(dt.date(1995, 1, 1) + dt.timedelta(days=min(x))))
                     for side, x in (("left", left), ("right", right))}
