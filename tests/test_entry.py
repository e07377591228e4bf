"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import differences, open_tables
from tillstream.plans import batch, stream

SF = "/root/testdata/sf0.001"
OWN = {**batch.QUERIES, **stream.QUERIES}
BATCH = [n for n in OWN if not n.startswith("stream_")]


@pytest.fixture(scope="module")
def duck():
    con = open_tables(SF)
    yield con
    con.close()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.queries()) and set(OWN) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", OWN)
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    assert differences(df, duck, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert word not in text


@pytest.mark.parametrize("name, needed", [
    ("kpi_cards", "GreaterThanOrEqual(ts,2024-01-02T00:00)"),
    ("dau_compare", "GreaterThanOrEqual(ts,2024-01-01T00:00)"),
    ("gmv_hourly", "EqualTo(event_type,purchase)"),
    ("sale_search_day", "LessThan(o_orderdate,1998-10-04T00:00)"),
])
def test_filters_reach_the_scan(spark, name, needed):
    text = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    pushed = [p.split("ReadSchema")[0] for p in text.split("PushedFilters: ")[1:]]
    assert any(needed in p for p in pushed)


@pytest.mark.parametrize("name, columns", [
    ("dau_total", {"ts", "user_id"}),
    ("gmv_total", {"o_orderdate", "o_totalprice"}),
    ("phone_mask", {"c_custkey", "c_name"}),
])
def test_scan_reads_only_needed_columns(spark, name, columns):
    text = plan(entry.queries()[name](spark, SF))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == columns


@pytest.mark.parametrize("name", ["dau_total", "dau_hourly", "new_devices", "gmv_total"])
def test_counts_stay_in_hash_aggregation(spark, name):
    assert "SortAggregate" not in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name, fact, exchanges", [
    ("sale_detail", "l_extendedprice", 1), ("gender_share", "l_orderkey", 1),
])
def test_facts_are_shuffled_once(spark, name, fact, exchanges):
    """Without broadcasts the details move once; buyers meet orders or counts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry.queries()[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    users = text.index("c_custkey")
    if name == "gender_share":
        assert "HashAggregate(keys=[user_id" in text[:users] or "HashAggregate(keys=[o_custkey" in text[:users]
    else:
        assert text.count("SortMergeJoin") == 2
        joined = text.index("SortMergeJoin", text.index("SortMergeJoin") + 1)
        assert "o_custkey" in text[joined:joined + 200] or "user_id" in text[joined:joined + 200]


def test_page_is_cut_before_users_join(spark):
    text = plan(entry.queries()["sale_search_deep"](spark, SF))
    assert text.index("Join") < text.index(f"limit={batch.PAGE_SIZE}")


def test_alert_listing_reuses_shuffles(spark):
    df = entry.queries()["alert_members"](spark, "/root/testdata/sf0.01")
    df.collect()
    assert plan(df).count("ReusedExchange") >= 2
