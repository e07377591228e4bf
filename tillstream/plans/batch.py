"""Batch queries by name: ``query(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream import schemas
from tillstream.functions import records, times
from tillstream.functions.text import mask_phone
from tillstream.operators import (
    activity, alerts, dedup, kpis, orders as order_ops, routing, sales, search,
)
from tillstream.plans import inputs
from tillstream.sources.changefeed import change_rows

AS_OF = "2024-01-01"
DAY = "2024-01-02"
SPLIT = "2024-01-16 12:00:00"
CLOCK_MS = 1704067200000

HOUR_MS = 3_600_000
DAY_RULE = alerts.AlertRule(
    coupon="purchase", click="click",
    window_ms=24 * HOUR_MS, slide_ms=6 * HOUR_MS, grain_ms=24 * HOUR_MS,
)
FINE_RULE = alerts.AlertRule(
    coupon="purchase", click="click",
    window_ms=12 * HOUR_MS, slide_ms=HOUR_MS // 4, grain_ms=HOUR_MS,
)


def log_rows(df: DataFrame) -> DataFrame:
    return df.select(
        times.date_text(F.col("ts")).alias("log_date"),
        times.hour_text(F.col("ts")).alias("log_hour"),
        "user_id", "event_id", "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
    )


def _daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed on the date itself; its text is made for the result rows only."""
    return inputs.activity_log(spark, sf_dir).withColumn("day", F.to_date("ts"))


def dau_first(spark, sf_dir):
    return log_rows(
        dedup.first_record(_daily_log(spark, sf_dir), ["day", "user_id"], ["ts"])
    )


def dau_total(spark, sf_dir):
    return activity.active_by_day(inputs.activity_log(spark, sf_dir), "user_id", "ts")


def dau_hourly(spark, sf_dir):
    return activity.active_by_hour(inputs.activity_log(spark, sf_dir), "user_id", "ts")


def dau_compare(spark, sf_dir):
    log = inputs.activity_log(spark, sf_dir).where(
        times.in_days("ts", times.previous_day(DAY), 2)
    )
    devices = activity.first_touch(log, "user_id", "ts").select(
        F.date_format("day", "yyyy-MM-dd").alias("logDate"),
        F.date_format("first_ts", "HH").alias("logHour"),
    )
    return kpis.fill_hours(kpis.hourly_metric("dau", DAY, devices, devices))


def amount_compare(spark, sf_dir):
    bought = inputs.table(spark, sf_dir, "events").where(
        (F.col("event_type") == "purchase")
        & times.in_days("ts", times.previous_day(DAY), 2)
    ).select(
        F.date_format("ts", "yyyy-MM-dd").alias("create_date"),
        F.date_format("ts", "HH").alias("create_hour"), F.col("value").alias("total_amount"),
    )
    return kpis.fill_hours(kpis.hourly_metric("order_amount", DAY, bought, bought))


def new_devices(spark, sf_dir):
    return activity.new_by_day(inputs.activity_log(spark, sf_dir), "user_id", "ts")


def dedup_incremental(spark, sf_dir):
    """Rows up to the split are stored; what do the later ones add?"""
    log = _daily_log(spark, sf_dir)
    seen = log.where(F.col("ts") < F.lit(SPLIT)).select("day", "user_id").distinct()
    batch = log.where(F.col("ts") >= F.lit(SPLIT))
    return log_rows(dedup.unseen_first(batch, seen, ["day", "user_id"], ["ts"]))


def records_per_batch(spark, sf_dir):
    return activity.records_per_interval(
        inputs.activity_log(spark, sf_dir), "ts", 3600
    )


def order_prepare(spark, sf_dir):
    raw = inputs.table(spark, sf_dir, "orders").select(
        *inputs.order_columns(), F.col("o_orderpriority").alias("consignee_tel")
    )
    return order_ops.prepare_orders(raw).select(
        "id", "consignee_tel", "create_date", "create_hour", "total_amount"
    )


def gmv_total(spark, sf_dir):
    # Grouped on the date itself; its text is made for the few result rows.
    day = F.to_date("o_orderdate")
    return order_ops.amount_by(
        inputs.table(spark, sf_dir, "orders"), [day.alias("day")], "o_totalprice"
    ).select(F.date_format("day", "yyyy-MM-dd").alias("create_date"), "amount")


def gmv_hourly(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    hours = order_ops.amount_by(
        rows, [F.to_date("ts").alias("d"), F.hour("ts").alias("h")], "value"
    )
    return hours.select(
        F.date_format("d", "yyyy-MM-dd").alias("create_date"),
        F.format_string("%02d", "h").alias("create_hour"), "amount",
    )


def phone_mask(spark, sf_dir):
    return inputs.table(spark, sf_dir, "customer").select(
        "c_custkey", mask_phone("c_name").alias("masked")
    )


def sale_detail(spark, sf_dir):
    """The buyer joins the order, so the details are shuffled once."""
    orders = sales.with_buyers(inputs.orders(spark, sf_dir), inputs.users(spark, sf_dir), AS_OF)
    return sales.join_details(orders, inputs.details(spark, sf_dir)).select(*sales.SALE_ORDER)


def sale_detail_ttl(spark, sf_dir):
    return sales.join_details(
        inputs.orders(spark, sf_dir), inputs.details(spark, sf_dir), ttl="100 days"
    )


def sale_detail_unique(spark, sf_dir):
    details = sales.unique_details(inputs.details(spark, sf_dir))
    return sales.join_details(inputs.orders(spark, sf_dir), details).select(
        "order_detail_id", "order_id", "user_id", "sku_price"
    )


def user_age(spark, sf_dir):
    return inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        sales.age_years(F.date_format("o_orderdate", "yyyy-MM-dd"), AS_OF).alias("age"),
    )


def latest_user(spark, sf_dir):
    log = inputs.activity_log(spark, sf_dir)
    return dedup.latest_record(log, ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
    )


def enrich_left(spark, sf_dir):
    """Every seventh order names a buyer that does not exist and gets the defaults."""
    buyer = F.when(F.pmod("id", F.lit(7)) == 0, -F.col("user_id")).otherwise(F.col("user_id"))
    rows = inputs.orders(spark, sf_dir).select(
        F.col("id").alias("order_detail_id"), F.col("id").alias("order_id"),
        "order_status", "create_time", buyer.alias("user_id"), F.col("id").alias("sku_id"),
        F.col("total_amount").alias("sku_price"),
        F.col("order_status").alias("sku_name"), F.col("create_date").alias("dt"),
    )
    return sales.enrich_users(rows, inputs.users(spark, sf_dir), AS_OF).select(
        "order_id", "user_id", "user_gender", "user_age", "user_level", "dt"
    )


def _alert_rows(spark, sf_dir, rule) -> DataFrame:
    return alerts.coupon_alerts(inputs.coupon_log(spark, sf_dir), rule)


def coupon_alert(spark, sf_dir):
    return _alert_rows(spark, sf_dir, DAY_RULE)


def coupon_alert_fine(spark, sf_dir):
    return _alert_rows(spark, sf_dir, FINE_RULE)


def alert_members(spark, sf_dir):
    pieces = alerts.alert_pieces(inputs.coupon_log(spark, sf_dir), DAY_RULE)
    return alerts.alert_members(alerts.alerts_from(pieces, DAY_RULE), pieces, DAY_RULE)


def alert_documents(spark, sf_dir):
    """Alert documents; arrays joined to text."""
    pieces = alerts.alert_pieces(inputs.coupon_log(spark, sf_dir), DAY_RULE)
    docs = alerts.alert_documents(
        alerts.alerts_from(pieces, DAY_RULE), pieces, DAY_RULE
    )
    listed = F.transform(
        "event_counts", lambda e: F.concat_ws("*", e["evid"], e["n"].cast("string"))
    )
    return docs.select(
        "doc_id", "users", "items", "events", "window_end", "parts", "part",
        F.array_join("uids", ",").alias("uids"),
        F.array_join("itemIds", ",").alias("item_ids"),
        F.array_join(listed, ",").alias("event_counts"),
    )


def _event_lines(spark, sf_dir) -> DataFrame:
    """Events as the JSON lines an app would send; item ids are bare numbers."""
    return inputs.table(spark, sf_dir, "events").select(
        F.to_json(F.struct(
            F.when(F.col("event_type") == "signup", "startup").otherwise("event")
            .alias("type"),
            F.get_json_object("props", "$.k").alias("mid"),
            F.col("user_id").cast("string").alias("uid"),
            F.col("event_type").alias("evid"),
            F.floor("value").cast("int").alias("itemid"),
            times.millis("ts").alias("ts"),
        )).alias("value"),
        "event_type",
    )


def event_parse(spark, sf_dir):
    lines = _event_lines(spark, sf_dir).select("value")
    rows = records.good_rows(
        records.parse_lines(lines, schemas.EVENT_LOG, ("mid", "ts"))
    )
    return times.with_log_time(
        rows, times.from_millis("ts"), "log_date", "log_hour"
    ).select("mid", "uid", "evid", "itemid", "ts", "log_date", "log_hour")


def startup_parse(spark, sf_dir):
    lines = _event_lines(spark, sf_dir).select("value")
    rows = records.good_rows(
        records.parse_lines(lines, schemas.STARTUP_LOG, ("mid", "ts"))
    ).where(F.col("type") == "startup")
    return times.with_log_time(
        rows, times.from_millis("ts"), "log_date", "log_hour"
    ).select("mid", "uid", "type", "ts", "log_date", "log_hour")


def order_parse(spark, sf_dir):
    """Orders as change-feed JSON (all values quoted), parsed and cleaned."""
    lines = inputs.table(spark, sf_dir, "orders").select(F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("consignee_tel"),
        inputs.money("o_totalprice").alias("total_amount"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("create_time"),
    )).alias("value"))
    parsed = records.parse_lines(lines, schemas.ORDER_INFO, ("id", "create_time"))
    return records.good_rows(order_ops.prepare_orders(parsed)).select(
        "id", "user_id", "order_status", "consignee_tel", "total_amount",
        "create_time", "create_date", "create_hour",
    )


def detail_parse(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "lineitem").select(F.to_json(F.struct(
        inputs.detail_id().alias("id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("sku_id"),
        inputs.money("l_extendedprice").alias("order_price"),
    )).alias("value"))
    parsed = records.parse_lines(lines, schemas.ORDER_DETAIL, ("id", "order_id"))
    return records.good_rows(parsed).select(
        "id", "order_id", "sku_id", F.col("order_price").try_cast("double").alias("sku_price")
    )


def user_parse(spark, sf_dir):
    lines = inputs.users(spark, sf_dir).select(
        records.to_line(["id", "login_name", "user_level", "birthday", "gender"])
        .alias("value")
    )
    parsed = records.parse_lines(lines, schemas.USER_INFO, ("id",))
    return records.good_rows(parsed)


def quarantine_split(spark, sf_dir):
    """Error events arrive cut short; they must end up in the quarantine."""
    lines = _event_lines(spark, sf_dir).select(
        F.when(F.col("event_type") == "error", F.substring("value", 1, 20))
        .otherwise(F.col("value")).alias("value")
    )
    parsed = records.parse_lines(lines, schemas.EVENT_LOG, ("mid", "ts"))
    return parsed.groupBy(F.col(records.BAD).alias("bad")).agg(
        F.count("*").alias("lines"), F.count("mid").alias("with_device")
    )


def log_route(spark, sf_dir):
    routed = routing.route_logs(_event_lines(spark, sf_dir), clock=F.lit(CLOCK_MS))
    stamped = F.get_json_object("value", "$.ts").cast("bigint")
    return routed.groupBy("topic").agg(
        F.count("*").alias("records"),
        F.count("key").alias("keyed"),
        F.min(stamped).alias("min_ts"),
        F.max(stamped).alias("max_ts"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def _change_entries(spark, sf_dir) -> DataFrame:
    """Orders, details and customers as change-feed entries, and suppliers as
    the users of another database."""

    def entry(df, name, event_type, entry_type, database=DATABASE, **after):
        pairs = [item for k, v in after.items() for item in (F.lit(k), v)]
        return df.select(
            entry_type.alias("entry_type"), F.lit(database).alias("database_name"),
            F.lit(name).alias("table_name"),
            event_type.alias("event_type"),
            F.array(F.struct(F.create_map(*pairs).alias("after"))).alias("row_datas"),
        )

    def kind(column, insert, update):
        return (
            F.when(F.col(column) == insert, "INSERT")
            .when(F.col(column) == update, "UPDATE").otherwise("DELETE")
        )

    row_data = F.lit("ROWDATA")
    orders = entry(
        inputs.table(spark, sf_dir, "orders"), "order_info",
        kind("o_orderstatus", "O", "F"),
        F.when(F.col("o_orderpriority") == "5-LOW", "TRANSACTIONEND").otherwise("ROWDATA"),
        id=F.col("o_orderkey").cast("string"),
        order_status=F.col("o_orderstatus"),
        total_amount=inputs.money("o_totalprice"),
    )
    details = entry(
        inputs.table(spark, sf_dir, "lineitem"), "order_detail",
        kind("l_returnflag", "A", "N"), row_data,
        id=inputs.detail_id(),
        order_id=F.col("l_orderkey").cast("string"),
        order_price=inputs.money("l_extendedprice"),
    )
    users = entry(
        inputs.table(spark, sf_dir, "customer"), "user_info",
        kind("c_mktsegment", "BUILDING", "MACHINERY"), row_data,
        id=F.col("c_custkey").cast("string"), login_name=F.col("c_name"),
    )
    parts = entry(
        inputs.table(spark, sf_dir, "part"), "sku_info", F.lit("INSERT"), row_data,
        id=F.col("p_partkey").cast("string"),
    )
    others = entry(
        inputs.table(spark, sf_dir, "supplier"), "user_info", F.lit("INSERT"), row_data,
        database="archive", id=F.col("s_suppkey").cast("string"),
    )
    return (
        orders.unionByName(details).unionByName(users).unionByName(parts).unionByName(others)
    )


def cdc_route(spark, sf_dir):
    return routing.route_changes(change_rows(_change_entries(spark, sf_dir), DATABASE))


def kpi_cards(spark, sf_dir):
    log = inputs.activity_log(spark, sf_dir)
    today = times.in_days("ts", DAY)
    active = activity.active_by_day(log.where(today), "user_id", "ts").agg(
        F.coalesce(F.sum("dau"), F.lit(0)).alias("value")
    )
    # Later records cannot change who was new on the day.
    so_far = log.where(times.until_day("ts", DAY))
    fresh = activity.new_by_day(so_far, "user_id", "ts").where(
        F.col("log_date") == DAY
    ).agg(F.coalesce(F.sum("new_devices"), F.lit(0)).alias("value"))
    amount = (
        inputs.table(spark, sf_dir, "events")
        .where(today & (F.col("event_type") == "purchase"))
        .agg(order_ops.amount_sum("value").alias("value"))
    )
    return kpis.kpi_cards(active, fresh, amount)


DATABASE = "shop"
KEYWORD = "Widget"
SEARCH_DAY = "1998-10-03"
PAGE, PAGE_SIZE = 2, 25
DEEP_AFTER = ("5", 0.0)
PAGE_ORDER = ("order_detail_id", "sku_price")


def _named_sales(spark, sf_dir) -> DataFrame:
    return sales.join_details(
        inputs.orders(spark, sf_dir), inputs.named_details(spark, sf_dir)
    )


def _matched_sales(spark, sf_dir) -> DataFrame:
    return search.match_sales(_named_sales(spark, sf_dir), keyword=KEYWORD)


def _page_with_buyers(spark, sf_dir, page: DataFrame) -> DataFrame:
    """The order of a page uses no buyer column: only its rows meet the users."""
    return sales.enrich_users(page, inputs.users(spark, sf_dir), AS_OF).orderBy(*PAGE_ORDER)


def sale_search(spark, sf_dir):
    page = search.page_rows(_matched_sales(spark, sf_dir), PAGE, PAGE_SIZE, PAGE_ORDER)
    return _page_with_buyers(spark, sf_dir, page)


def sale_search_deep(spark, sf_dir):
    """The page after a given row, somewhere in the middle of the result."""
    page = search.page_after(_matched_sales(spark, sf_dir), DEEP_AFTER, PAGE_SIZE, PAGE_ORDER)
    return _page_with_buyers(spark, sf_dir, page)


def sale_search_day(spark, sf_dir):
    """All sales of a day."""
    orders = inputs.table(spark, sf_dir, "orders").where(
        times.in_days("o_orderdate", SEARCH_DAY)
    ).select(*inputs.order_columns())
    # The day cuts the details before these look up the names of their items.
    sold = sales.join_details(
        sales.with_buyers(orders, inputs.users(spark, sf_dir), AS_OF), inputs.details(spark, sf_dir))
    rows = sold.drop("sku_name").join(inputs.item_names(spark, sf_dir), "sku_id")
    return search.match_sales(rows).select(*sales.SALE_ORDER)


def sale_search_total(spark, sf_dir):
    return search.total_rows(_matched_sales(spark, sf_dir))


def _matched_buyers(spark, sf_dir) -> DataFrame:
    return search.per_buyer(_matched_sales(spark, sf_dir), inputs.users(spark, sf_dir), AS_OF)


def gender_share(spark, sf_dir):
    return search.gender_share(_matched_buyers(spark, sf_dir), "n")


def age_share(spark, sf_dir):
    return search.age_share(_matched_buyers(spark, sf_dir), "n")


def region_volume(spark, sf_dir):
    """Orders per nation of the buyer.

    Reduced per buyer first, so the join carries one row per buyer and a buyer
    with very many orders is no hot key.
    """
    per_buyer = (
        inputs.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
            F.count("*").alias("n"),
            F.try_sum(order_ops.exact_amount("o_totalprice")).alias("amount"),
        )
    )
    buyers = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = inputs.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_nation = (
        per_buyer.join(buyers, per_buyer.o_custkey == buyers.c_custkey)
        .groupBy("c_nationkey")
        .agg(F.sum("n").alias("orders"), order_ops.rounded(F.try_sum("amount")).alias("amount"))
    )
    return per_nation.join(nations, per_nation.c_nationkey == nations.n_nationkey).select(
        F.col("n_name").alias("region"), "orders", "amount"
    )


def order_volume(spark, sf_dir):
    return search.region_volume(
        inputs.table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"
    )


QUERIES = {
    q.__name__: q
    for q in (
        dau_first, dau_total, dau_hourly, dau_compare, amount_compare, new_devices,
        dedup_incremental, records_per_batch, order_prepare, gmv_total, gmv_hourly,
        phone_mask, sale_detail, sale_detail_ttl, sale_detail_unique, user_age,
        latest_user, enrich_left, coupon_alert, coupon_alert_fine, alert_members,
        alert_documents, event_parse, startup_parse, order_parse, detail_parse,
        user_parse, quarantine_split, log_route, cdc_route, kpi_cards, sale_search,
        sale_search_deep, sale_search_day, sale_search_total, gender_share, age_share, region_volume,
        order_volume,
    )
}
