"""Hand-made inputs and their expected results, shared by batch and stream tests."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

BASE = datetime(2021, 1, 11, 12, 0, 0, tzinfo=timezone.utc)


def ms(moment: datetime) -> int:
    return int(moment.timestamp() * 1000)


def at(day: int, second: int) -> int:
    """Milliseconds of 12:00:``second`` on a January day."""
    return ms(datetime(2021, 1, day, 12, 0, second, tzinfo=timezone.utc))


def startup(mid: str, ts: int) -> str:
    return json.dumps({
        "type": "startup", "mid": mid, "uid": "7", "os": "ios", "appid": "shop",
        "area": "beijing", "ch": "appstore", "vs": "1.2.0", "ts": ts,
    })


FIRST_FILES = [
    [startup("m1", at(11, 9)), startup("m1", at(11, 3)), startup("m2", at(11, 0))],
    [startup("m1", at(11, 1)), startup("m1", at(12, 0)), startup("m3", at(11, 0))],
    [startup("m4", at(14, 0))],
]
FIRST_STREAM = {
    ("2021-01-11", "m1", at(11, 3)), ("2021-01-11", "m2", at(11, 0)),
    ("2021-01-12", "m1", at(12, 0)), ("2021-01-11", "m3", at(11, 0)),
    ("2021-01-14", "m4", at(14, 0)),
}
FIRST_BATCH = (FIRST_STREAM - {("2021-01-11", "m1", at(11, 3))}) | {
    ("2021-01-11", "m1", at(11, 1))
}


def event(mid: str, uid: int, evid: str, item: int, second: float) -> str:
    return json.dumps({
        "type": "event", "mid": mid, "uid": str(uid), "os": "ios", "appid": "shop",
        "area": "beijing", "evid": evid, "pgid": 3, "npgid": 4, "itemid": item,
        "ts": ms(BASE + timedelta(seconds=second)),
    })


ALERT_LINES = (
    [event("m1", i, "coupon", i, 7 * i) for i in range(4)]
    + [event("m2", i, "coupon", 9, i) for i in range(3)]
    + [event("m2", 1, "clickItem", 9, 40)]
)
# Later records of another device move the watermark past all windows above.
ALERT_CLOSING = [event("m9", 1, "addCart", 1, 3600), event("m9", 1, "addCart", 1, 7200)]


def _end(text: str) -> int:
    return ms(datetime.fromisoformat(f"2021-01-11T{text}+00:00"))


# (doc_id, last window end, users, items, events)
ALERTS = {
    ("m1-26839440", _end("12:00:55"), 4, 4, 4),
    ("m1-26839441", _end("12:01:55"), 4, 4, 4),
    ("m1-26839442", _end("12:02:55"), 4, 4, 4),
    ("m1-26839443", _end("12:03:55"), 4, 4, 4),
    ("m1-26839444", _end("12:04:55"), 4, 4, 4),
    ("m1-26839445", _end("12:05:05"), 3, 3, 3),
    ("m2-26839440", _end("12:00:40"), 3, 1, 3),
}


def order(order_id: str, user: str = "5", **changes) -> str:
    row = {
        "id": order_id, "province_id": "6", "consignee": "Uw", "order_comment": "",
        "consignee_tel": "13741234567", "order_status": "1", "payment_way": "1",
        "user_id": user, "img_url": "", "total_amount": "59.0",
        "create_time": "2021-01-09 05:38:37",
    }
    row.update(changes)
    return json.dumps(row)


def detail(detail_id: str, order_id: str, **changes) -> str:
    row = {
        "id": detail_id, "order_id": order_id, "sku_name": "Phone 10", "sku_id": "1",
        "order_price": "2220.0", "img_url": "", "sku_num": "1",
    }
    row.update(changes)
    return json.dumps(row)


def user(user_id: str, **changes) -> str:
    row = {
        "id": user_id, "login_name": "n" + user_id, "user_level": "1",
        "birthday": "1990-01-01", "gender": "F",
    }
    row.update(changes)
    return json.dumps(row)
