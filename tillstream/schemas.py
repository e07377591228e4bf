"""Record schemas of the log and change feeds.

Types are the target types.  Feeds deliver many numbers as quoted strings, so
parsing goes through strings (see ``functions.records``).
"""

from __future__ import annotations

from pyspark.sql import types as T


def _record(fields: list[str], **typed: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField(name, typed.get(name, T.StringType())) for name in fields
    ])


# The fields of each record, in the order of the feeds' contract.
STARTUP_LOG = _record(
    ["mid", "uid", "appid", "area", "os", "ch", "type", "vs", "ts"], ts=T.LongType()
)

EVENT_LOG = _record(
    ["mid", "uid", "appid", "area", "os", "type", "evid", "pgid", "npgid", "itemid", "ts"],
    ts=T.LongType(),
)

ORDER_INFO = _record(
    ["id", "province_id", "consignee", "order_comment", "consignee_tel", "order_status",
     "payment_way", "user_id", "img_url", "total_amount", "expire_time", "delivery_address",
     "create_time", "operate_time", "tracking_no", "parent_order_id", "out_trade_no",
     "trade_body"],
    total_amount=T.DoubleType(),
)

ORDER_DETAIL = _record(
    ["id", "order_id", "sku_name", "sku_id", "order_price", "img_url", "sku_num"]
)

USER_INFO = _record(["id", "login_name", "user_level", "birthday", "gender"])

# One entry of the change feed: a statement on one table touching many rows.
CHANGE_ENTRY = T.StructType([
    T.StructField("entry_type", T.StringType()),
    T.StructField("database_name", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField(
        "row_datas",
        T.ArrayType(T.StructType([
            T.StructField("after", T.MapType(T.StringType(), T.StringType())),
        ])),
    ),
])

# Columns of the stored tables, in storage order.
DAU_COLUMNS = [
    "mid", "uid", "appid", "area", "os", "ch", "type", "vs",
    "logDate", "logHour", "ts",
]
ORDER_COLUMNS = [
    "id", "province_id", "consignee", "order_comment", "consignee_tel",
    "order_status", "payment_way", "user_id", "img_url", "total_amount",
    "expire_time", "delivery_address", "create_time", "operate_time",
    "tracking_no", "parent_order_id", "out_trade_no", "trade_body",
    "create_date", "create_hour",
]
SALE_COLUMNS = [
    "order_detail_id", "order_id", "order_status", "create_time", "user_id",
    "sku_id", "user_gender", "user_age", "user_level", "sku_price",
    "sku_name", "dt",
]
