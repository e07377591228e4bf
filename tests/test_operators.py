"""Batch operators on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from tests import goldens as g
from tillstream import schemas
from tillstream.functions import records, text, times
from tillstream.operators import (
    activity, dedup, kpis, orders, routing, sales, search,
)
from tillstream.sources.changefeed import change_rows, parse_entries


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- parsing ---------------------------------------------------------------

def test_parse_types_and_quarantine(spark):
    parsed = records.parse_lines(
        lines(
            spark,
            '{"mid":"a","ts":1610000000000,"itemid":4,"pgid":12}',
            '{"mid":"b","ts":"1610000000001","itemid":"5"}',
            '{"mid":"c","ts":"soon"}',
            '{"mid":"d"}',
            '{"ts":1}',
            '{"mid":"e","ts":1',
            "plain",
            "",
            None,
        ),
        schemas.EVENT_LOG, ("mid", "ts"),
    )
    assert rows(records.good_rows(parsed), "mid", "ts", "itemid") == [
        ("a", 1610000000000, "4"), ("b", 1610000000001, "5"),
    ]
    assert records.bad_rows(parsed).count() == 7
    assert parsed.count() == 9


def test_quoted_amount(spark):
    parsed = records.parse_lines(
        lines(spark, g.order("1"), g.order("2", total_amount="x"), g.order("3", total_amount=7)),
        schemas.ORDER_INFO, ("id",),
    )
    assert rows(records.good_rows(parsed), "id", "total_amount") == [("1", 59.0), ("3", 7.0)]


def test_parse_keeps_other_columns(spark):
    df = lines(spark, g.user("5")).withColumn("ingest_time", F.lit(3))
    row = records.good_rows(records.parse_lines(df, schemas.USER_INFO, ("id",))).first()
    assert (row.ingest_time, row.id, row.birthday) == (3, "5", "1990-01-01")


# --- projections -----------------------------------------------------------

def test_log_time(spark):
    df = spark.createDataFrame([(g.at(11, 9),), (0,)], "ts long")
    out = times.with_log_time(df, times.from_millis("ts"))
    assert rows(out, "logDate", "logHour") == [("1970-01-01", "00"), ("2021-01-11", "12")]


def test_log_time_follows_session_zone(spark):
    df = spark.createDataFrame([(g.ms(g.BASE) + 5 * 3_600_000,)], "ts long")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        out = times.with_log_time(df, times.from_millis("ts"))
        assert rows(out, "logDate", "logHour") == [("2021-01-12", "01")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_mask_and_create_time(spark):
    df = spark.createDataFrame(
        [("2021-01-09 05:38:37", "13741234567"), ("2021-01-09", "12"), (None, None)],
        "create_time string, consignee_tel string",
    )
    assert rows(
        orders.prepare_orders(df), "consignee_tel", "create_date", "create_hour"
    ) == sorted([
        ("1374*******", "2021-01-09", "05"), ("12*******", "2021-01-09", ""),
        (None, None, None),
    ], key=repr)


@pytest.mark.parametrize("birthday, as_of, age", [
    ("1990-01-01", "2021-01-12", 31),
    ("2000-01-01", "2020-12-28", 21),
    ("2020-12-29", "2020-12-28", 0),
    ("2020-01-01", "2020-12-31", 1),
    ("2020-01-01", "2020-12-30", 0),
    ("no date", "2020-12-28", None),
    (None, "2020-12-28", None),
])
def test_age(spark, birthday, as_of, age):
    df = spark.createDataFrame([(birthday,)], "b string")
    assert df.select(sales.age_years(F.col("b"), as_of)).first()[0] == age


def test_names_and_days(spark):
    df = spark.createDataFrame([(1, 2)], "mid int, logDate int")
    assert text.upper_names(df).columns == ["MID", "LOGDATE"]
    assert times.previous_day("2021-03-01") == "2021-02-28"


# --- routing ---------------------------------------------------------------

def test_route_logs(spark):
    df = lines(
        spark, '{"type":"startup","mid":"a","ts":1,"pgid":4}', '{"type":"event","mid":"b"}',
        '{"mid":"c"}', "junk",
    )
    out = routing.route_logs(df, clock=F.lit(99))
    assert rows(out, "topic", "key") == sorted([
        ("startup_log", "a"), ("event_log", "b"), ("event_log", "c"), (None, None),
    ], key=repr)
    values = {r.key: r.value for r in out.collect()}
    assert json.loads(values["a"]) == {"type": "startup", "mid": "a", "ts": 99, "pgid": 4}
    assert values[None] == "junk"
    again = records.parse_lines(out.select("value"), schemas.EVENT_LOG, ("mid", "ts"))
    assert {r.ts for r in records.good_rows(again).collect()} == {99}


def test_route_changes(spark):
    entry = {"entry_type": "ROWDATA", "table_name": "order_info", "event_type": "INSERT",
             "row_datas": [{"after": {"id": "1", "x": "2.0"}}, {"after": {"id": "2"}}]}
    other = {**entry, "entry_type": "TRANSACTIONBEGIN"}
    update = {**entry, "event_type": "UPDATE"}
    df = lines(spark, *[json.dumps(e) for e in (entry, other, update)])
    out = routing.route_changes(change_rows(parse_entries(df)))
    assert rows(out, "topic", "key", "value") == [
        ("order_info", "1", '{"id":"1","x":"2.0"}'), ("order_info", "2", '{"id":"2"}'),
    ]


# --- dedup and activity ----------------------------------------------------

def test_first_latest_ties(spark):
    df = spark.createDataFrame(
        [("a", 1, "y"), ("a", 1, "x"), ("a", 2, "z"), ("b", 5, None)],
        "k string, t int, v string",
    )
    for shuffled in (df, df.orderBy(F.desc("v")), df.repartition(3)):
        assert rows(dedup.first_record(shuffled, ["k"], ["t"]), "k", "t", "v") == [
            ("a", 1, "x"), ("b", 5, None),
        ]
        assert rows(dedup.latest_record(shuffled, ["k"], ["t"]), "k", "t", "v") == [
            ("a", 2, "z"), ("b", 5, None),
        ]


def test_unseen_first(spark):
    batch = spark.createDataFrame(
        [("d1", "a", 2), ("d1", "a", 1), ("d1", "b", 1), ("d2", "a", 9)],
        "d string, m string, t int",
    )
    seen = spark.createDataFrame([("d1", "b")], "d string, m string")
    assert rows(dedup.unseen_first(batch, seen, ["d", "m"], ["t"]), "d", "m", "t") == [
        ("d1", "a", 1), ("d2", "a", 9),
    ]


def touches(spark):
    return spark.createDataFrame(
        [("a", "2021-01-01 08:10:00"), ("a", "2021-01-01 09:00:00"),
         ("a", "2021-01-03 01:00:00"), ("b", "2021-01-01 23:59:59"),
         ("b", "2021-01-02 00:00:00"), ("c", "2021-01-03 08:00:00")],
        "mid string, t string",
    ).withColumn("t", F.col("t").cast("timestamp"))


def test_activity_counts(spark):
    log = touches(spark)
    assert rows(activity.active_by_day(log, "mid", "t"), "log_date", "dau") == [
        ("2021-01-01", 2), ("2021-01-02", 1), ("2021-01-03", 2),
    ]
    assert rows(activity.active_by_hour(log, "mid", "t"), "log_date", "log_hour", "dau") == [
        ("2021-01-01", "08", 1), ("2021-01-01", "23", 1), ("2021-01-02", "00", 1),
        ("2021-01-03", "01", 1), ("2021-01-03", "08", 1),
    ]
    assert rows(activity.new_by_day(log, "mid", "t"), "log_date", "new_devices") == [
        ("2021-01-01", 2), ("2021-01-03", 1),
    ]


# --- KPIs ------------------------------------------------------------------

def dau_table(spark, counts):
    return spark.createDataFrame(
        [(d, h, f"m{i}") for (d, h), n in counts.items() for i in range(n)],
        "logDate string, logHour string, mid string",
    )


def order_table(spark, *data):
    return spark.createDataFrame(
        list(data), "create_date string, create_hour string, total_amount double"
    )


def test_hourly_shape(spark):
    dau = dau_table(spark, {("2021-01-09", "08"): 70, ("2021-01-09", "09"): 90,
                            ("2021-01-08", "09"): 5, ("2021-01-07", "01"): 3})
    none = order_table(spark).where("false")
    compared = kpis.hourly_metric("dau", "2021-01-09", dau, none)
    assert rows(compared, "hour", "today", "yesterday") == [("08", 70, None), ("09", 90, 5)]
    filled = {r.hour: (r.today, r.yesterday) for r in kpis.fill_hours(compared).collect()}
    assert len(filled) == 24
    assert filled["08"] == (70, 0) and filled["09"] == (90, 5)
    assert sum(t for t, _ in filled.values()) == 160
    assert json.loads(kpis.as_hour_maps(compared).first().value) == {
        "today": {"08": 70, "09": 90}, "yesterday": {"09": 5},
    }


def test_hourly_amount_and_unknown_metric(spark):
    dau = dau_table(spark, {("2021-01-09", "08"): 1})
    table = order_table(
        spark, ("2021-01-09", "08", 0.1), ("2021-01-09", "08", 0.2), ("2021-01-08", "10", 5.0)
    )
    assert rows(
        kpis.hourly_metric("order_amount", "2021-01-09", dau, table),
        "hour", "today", "yesterday",
    ) == [("08", 0.3, None), ("10", None, 5.0)]
    assert kpis.hourly_metric("other", "2021-01-09", dau, table).count() == 0


def test_totals_of_an_empty_day(spark):
    dau = dau_table(spark, {("2021-01-09", "08"): 2})
    table = order_table(spark, ("2021-01-09", "08", 1.5))
    assert activity.dau_total(dau, "2021-01-09").first().value == 2
    assert activity.dau_total(dau, "2020-01-01").first().value == 0
    assert orders.amount_total(table, "2021-01-09").first().value == 1.5
    assert orders.amount_total(table, "2020-01-01").first().value is None


def test_cards(spark):
    one = spark.createDataFrame([(12.0,)], "value double")
    empty = spark.createDataFrame([(None,)], "value double")
    cards = kpis.kpi_cards(one, one, empty)
    assert rows(cards, "id", "name", "value") == sorted([
        ("dau", "新增日活", 12.0), ("new_mid", "新增设备", 12.0),
        ("order_amount", "新增交易额", None),
    ], key=repr)
    assert [c["id"] for c in json.loads(kpis.cards_json(cards).first().value)] == [
        "dau", "new_mid", "order_amount",
    ]


def test_realtime_total(spark):
    dau = spark.createDataFrame(
        [("2021-01-08", "a"), ("2021-01-09", "a"), ("2021-01-09", "b"),
         ("2021-01-09", "c"), ("2021-01-10", "d")],
        "logDate string, mid string",
    )
    table = order_table(spark, ("2021-01-09", "08", 1.5), ("2021-01-08", "08", 9.0))
    cards = kpis.realtime_total(dau, table, "2021-01-09")
    assert {r.id: r.value for r in cards.collect()} == {
        "dau": 3.0, "new_mid": 2.0, "order_amount": 1.5,
    }


# --- sales and search ------------------------------------------------------

def sale_inputs(spark):
    o = spark.createDataFrame(
        [("1", "S", "2021-01-09 05:00:00", "u1", "2021-01-09"),
         ("2", "S", "2021-01-09 06:00:00", "u2", "2021-01-09")],
        "id string, order_status string, create_time string, user_id string, create_date string",
    )
    d = spark.createDataFrame(
        [("a", "1", "k1", "Red Phone", "10.5"), ("b", "1", "k2", "blue 100%_case", "x"),
         ("c", "2", "k1", "red phone", "7"), ("d", "9", "k1", "lost", "1")],
        "id string, order_id string, sku_id string, sku_name string, order_price string",
    )
    u = spark.createDataFrame(
        [("u1", "F", "1990-01-01", "2")],
        "id string, gender string, birthday string, user_level string",
    )
    return o, d, u


def test_sale_rows(spark):
    o, d, u = sale_inputs(spark)
    out = sales.enrich_users(sales.join_details(o, d), u, "2021-01-12")
    assert out.columns == schemas.SALE_COLUMNS
    assert rows(out, "order_detail_id", "user_gender", "user_age", "user_level", "sku_price") == [
        ("a", "F", 31, "2", 10.5), ("b", "F", 31, "2", None), ("c", None, 0, None, 7.0),
    ]


def test_unique_details(spark):
    o, d, _ = sale_inputs(spark)
    twice = d.unionByName(d)
    assert sales.join_details(o, twice).count() == 6
    assert sales.join_details(o, sales.unique_details(twice)).count() == 3


def test_search(spark):
    o, d, u = sale_inputs(spark)
    out = sales.enrich_users(sales.join_details(o, d), u, "2021-01-12")
    red = search.match_sales(out, "2021-01-09", "RED")
    assert search.total_rows(red).first().total == 2
    assert rows(search.page_rows(red, 2, 1), "order_detail_id") == [("c",)]
    assert search.page_rows(red, 3, 1).count() == 0
    assert search.match_sales(out, "2021-01-10").count() == 0
    assert rows(search.match_sales(out, keyword="%_c"), "order_detail_id") == [("b",)]
    with pytest.raises(ValueError):
        search.page_rows(red, 0, 1)
    answer = search.search_sales(out, "2021-01-09", "red", 1, 10)
    assert answer["total"].first().total == answer["detail"].count() == 2
    assert sum(r.value for r in answer["age"].collect()) == 2
    assert rows(search.gender_share(out), "name", "value", "share") == sorted(
        [("F", 2, 66.67), (None, 1, 33.33)], key=repr
    )
    assert rows(search.age_share(out), "name", "value") == sorted(
        [("30岁以上", 2), ("20岁以下", 1)], key=repr
    )


@pytest.mark.parametrize("age, group", [
    (19, "20岁以下"), (20, "20-30岁"), (29, "20-30岁"), (30, "30岁以上"),
])
def test_age_groups(spark, age, group):
    df = spark.createDataFrame([(age,)], "age int")
    assert df.select(search.age_group("age")).first()[0] == group


def test_pages_by_key_reach_any_depth(spark):
    df = spark.range(1000).select(
        F.pmod(F.col("id") * 389, F.lit(1000)).alias("a"), F.lit("x").alias("b")
    ).repartition(7)
    got, after = [], None
    while page := search.page_after(df, after, 150, ("b", "a")).collect():
        got += [r.a for r in page]
        after = (page[-1].b, page[-1].a)
    assert got == list(range(1000))
    plan = search.page_after(df, ("x", 900), 25, ("b", "a"))._jdf.queryExecution()
    assert "TakeOrderedAndProject(limit=25" in plan.executedPlan().toString()
    with pytest.raises(ValueError, match="page_after"):
        search.page_rows(df, 401, 25)


def test_a_search_goes_past_the_numbered_pages(spark, monkeypatch):
    o, d, u = sale_inputs(spark)
    out = sales.enrich_users(sales.join_details(o, d), u, "2021-01-12")
    monkeypatch.setattr(search, "PAGED_ROWS", 1)
    with pytest.raises(ValueError, match="page_after"):
        search.search_sales(out, None, None, 2, 1)
    got = [r.order_detail_id for r in search.search_sales(out, None, None, 1, 1)["detail"].collect()]
    while page := search.search_sales(out, None, None, 1, 1, after=(got[-1],))["detail"].collect():
        got += [r.order_detail_id for r in page]
    assert got == ["a", "b", "c"]


def test_search_answer_is_one_object(spark):
    o, d, u = sale_inputs(spark)
    out = sales.enrich_users(sales.join_details(o, d), u, "2021-01-12")
    answer = search.search_answer(search.search_sales(out, "2021-01-09", "red", 1, 10))
    got = json.loads(answer.first().value)
    assert got["total"] == 2 and len(got["detail"]) == 2
    assert sum(r["value"] for r in got["stat"]["age"]) == 2
    nothing = search.search_answer(search.search_sales(out, "1999-01-01", None, 1, 10))
    assert json.loads(nothing.first().value)["total"] == 0


def test_buyers_join_at_orders_or_counts(spark):
    o, d, u = sale_inputs(spark)
    late = sales.enrich_users(sales.join_details(o, d), u, "2021-01-12")
    early = sales.join_details(sales.with_buyers(o, u, "2021-01-12"), d).select(*late.columns)
    assert rows(early, *late.columns) == rows(late, *late.columns)
    counted = search.per_buyer(sales.join_details(o, d), u, "2021-01-12")
    assert rows(search.gender_share(counted, "n"), "name", "value") == rows(
        search.gender_share(late), "name", "value")


def test_amounts_keep_small_digits(spark):
    df = spark.createDataFrame([("d", 0.004)] * 1000 + [("e", 1e14)] * 3, "d string, a double")
    got = {r.d: r.amount for r in orders.amount_by(df, ["d"], "a").collect()}
    assert got == {"d": 4.0, "e": 3e14}


@pytest.mark.parametrize("amount", ["NaN", "Infinity", "1e17", "-1e300"])
def test_unusable_amounts_are_bad(spark, amount):
    line = json.dumps({"id": "1", "create_time": "2021-01-09 05:00:00", "total_amount": amount})
    parsed = records.parse_lines(lines(spark, line), schemas.ORDER_INFO, ("id", "create_time"))
    assert [r[records.BAD] for r in orders.prepare_orders(parsed).collect()] == [True]


def test_other_databases_are_dropped(spark):
    entry = {"entry_type": "ROWDATA", "database_name": "shop", "table_name": "order_info",
             "event_type": "INSERT", "row_datas": [{"after": {"id": "1"}}]}
    twin = {**entry, "database_name": "old", "row_datas": [{"after": {"id": "2"}}]}
    df = parse_entries(lines(spark, json.dumps(entry), json.dumps(twin)))
    assert rows(routing.route_changes(change_rows(df, "shop")), "key") == [("1",)]
    assert routing.route_changes(change_rows(df)).count() == 2


def test_unique_orders(spark):
    o, d, _ = sale_inputs(spark)
    assert sales.join_details(sales.unique_orders(o.unionByName(o)), d).count() == 3


def test_region_volume(spark):
    df = spark.createDataFrame([("6", 1.25), ("6", 2.5), ("7", 1.0)], "p string, a double")
    assert rows(search.region_volume(df, "p", "a"), "region", "orders", "amount") == [
        ("6", 2, 3.75), ("7", 1, 1.0),
    ]
