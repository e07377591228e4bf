"""The same results in SQL, written independently of the Spark plans.

Sliding windows are expanded record by record and counted naively, first
records are ranked, ages and text are spelled out: these are the brute-force
definitions the operators are checked against.
"""

from __future__ import annotations

from tillstream.plans import batch, stream


def _day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def _hour(column: str) -> str:
    return f"strftime({column}, '%H')"


# Doubles added with compensation, rounded once.
_MONEY = "round(fsum({0}), 6)"

_DATED = f"""
  select user_id, event_id, event_type, ts,
         {_day('ts')} as log_date, {_hour('ts')} as log_hour
  from events
"""

_FIRSTS = f"""
  select * from ({_DATED}) e
  qualify row_number() over (partition by log_date, user_id
                             order by ts, event_id, event_type) = 1
"""

_LOG_ROWS = "log_date, log_hour, user_id, event_id, event_type, epoch_us(ts) as ts_us"


def _compare(source: str) -> str:
    """Two-day comparison of ``day, hour, value`` rows, zero-filled."""
    return f"""
    with hours as ({source}),
    spine as (select printf('%02d', i) as hour from range(24) t(i)),
    today as (select hour, value from hours where day = '{batch.DAY}'),
    before as (select hour, value from hours where day = '2024-01-01')
    select s.hour, coalesce(t.value, 0) as today, coalesce(b.value, 0) as yesterday
    from spine s left join today t on s.hour = t.hour
                 left join before b on s.hour = b.hour
    """


_DAU_HOURS = f"""
  select log_date as day, log_hour as hour, count(*) as value
  from ({_FIRSTS}) f group by 1, 2
"""

_AMOUNT_HOURS = f"""
  select {_day('ts')} as day, {_hour('ts')} as hour, {_MONEY.format('value')} as value
  from events where event_type = 'purchase' group by 1, 2
"""

_ORDERS = f"""
  select o_orderkey as id, o_orderstatus as order_status,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as create_time,
         {_day('o_orderdate')} as dt, o_custkey as user_id, o_orderdate as order_time
  from orders
"""

_DETAIL_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
)

_DETAILS = f"""
  select {_DETAIL_ID} as id, l_orderkey as order_id, l_partkey as sku_id,
         l_returnflag || l_linestatus as sku_name, l_extendedprice as order_price,
         l_shipdate as detail_time
  from lineitem
"""

_NAMED_DETAILS = f"""
  select d.* replace (p_name as sku_name) from ({_DETAILS}) d
  join part on p_partkey = d.sku_id
"""


def _age(birthday: str) -> str:
    return (
        f"cast(trunc(datediff('day', {birthday}, date '{batch.AS_OF}') / 365) as integer)"
    )


_USERS = f"""
  select c_custkey as user_id, c_mktsegment as user_gender,
         cast(c_nationkey as varchar) as user_level,
         {_age("(date '2008-01-01' - cast(floor(c_acctbal) as integer))")} as age
  from customer
"""


def _sales(details: str, where: str = "true") -> str:
    return f"""
    select d.id as order_detail_id, o.id as order_id, o.order_status, o.create_time,
           o.user_id, d.sku_id, d.order_price as sku_price, d.sku_name, o.dt
    from ({_ORDERS}) o join ({details}) d on o.id = d.order_id where {where}
    """


def _with_users(sales: str) -> str:
    return f"""
    select s.*, u.user_gender, coalesce(u.age, 0) as user_age, u.user_level
    from ({sales}) s left join ({_USERS}) u on s.user_id = u.user_id
    """


_MATCHED = _with_users(
    f"select * from ({_sales(_NAMED_DETAILS)}) x where contains(lower(sku_name), 'widget')"
)

_COUPON_LOG = """
  select json_extract_string(props, '$.k') as mid, cast(user_id as varchar) as uid,
         event_type as evid, cast(cast(floor(value) as bigint) as varchar) as itemid,
         ts as event_time
  from events
"""


def _windowed(rule) -> str:
    """Every record once per window that holds it."""
    s, length = rule.slide_ms, rule.window_ms
    first = f"(epoch_us(event_time) // 1000 // {s} + 1) * {s}"
    return f"""
    select mid, uid, evid, itemid,
           unnest(range({first}, {first} + {length}, {s})) as window_end
    from ({_COUPON_LOG}) c
    """


def _alerts(rule, closed: str = "true") -> str:
    g = rule.grain_ms
    return f"""
    with w as ({_windowed(rule)}),
    counted as (
      select mid, window_end,
             count(distinct case when evid = '{rule.coupon}' then uid end) as users,
             count(distinct case when evid = '{rule.coupon}' then itemid end) as items,
             count(*) as events
      from w group by mid, window_end
      having count(distinct case when evid = '{rule.coupon}' then uid end) >= {rule.min_users}
         and count(case when evid = '{rule.click}' then 1 end) = 0
    )
    select mid || '-' || (window_end // {g}) as doc_id,
           strftime(make_timestamp(window_end * 1000), '%Y-%m-%d') as alert_date,
           mid, window_end, users, items, events
    from counted where {closed}
    qualify row_number() over (partition by mid, window_end // {g}
                               order by window_end desc) = 1
    """


def _members(rule, closed: str = "true") -> str:
    return f"""
    with w as ({_windowed(rule)}),
    a as ({_alerts(rule, closed)}),
    hit as (select a.doc_id, a.alert_date, w.* from a
            join w on a.mid = w.mid and a.window_end = w.window_end)
    select doc_id, alert_date, 'user' as kind, uid as member, cast(1 as bigint) as n
    from hit where evid = '{rule.coupon}' group by all
    union all
    select doc_id, alert_date, 'item', itemid, cast(1 as bigint)
    from hit where evid = '{rule.coupon}' group by all
    union all
    select doc_id, alert_date, 'event', evid, count(*) from hit group by all
    """


_DOCUMENTS = f"""
with m as ({_members(batch.DAY_RULE)}), h as ({_alerts(batch.DAY_RULE)}),
listed as (
  select doc_id,
    string_agg(case when kind = 'user' then member end, ',' order by member) as uids,
    string_agg(case when kind = 'item' then member end, ',' order by member) as item_ids,
    string_agg(case when kind = 'event' then member || '*' || n end, ',' order by member)
      as event_counts
  from m group by doc_id
)
select doc_id, users, items, events, window_end, cast(1 as bigint) as parts,
       cast(0 as bigint) as part, uids, item_ids, event_counts
from h join listed using (doc_id)
"""


def _change(name: str, table: str, column: str, insert: str, update: str, body: str,
            where: str = "true") -> str:
    return f"""
    select '{name}' as table_name,
           case {column} when '{insert}' then 'INSERT' when '{update}' then 'UPDATE'
                else 'DELETE' end as event_type,
           cast({body} as varchar) as value, id as key
    from (select *, {{id}} as id from {table}) t where {where}
    """


def _text_money(column: str) -> str:
    return f"cast(cast({column} as decimal(18,2)) as varchar)"


_CDC = f"""
with changes as (
{_change('order_info', 'orders', 'o_orderstatus', 'O', 'F',
         "json_object('id', id, 'order_status', o_orderstatus, 'total_amount', "
         + _text_money('o_totalprice') + ")",
         "o_orderpriority <> '5-LOW'").format(id='cast(o_orderkey as varchar)')}
union all
{_change('order_detail', 'lineitem', 'l_returnflag', 'A', 'N',
         "json_object('id', id, 'order_id', cast(l_orderkey as varchar), 'order_price', "
         + _text_money('l_extendedprice') + ")").format(id=_DETAIL_ID)}
union all
{_change('user_info', 'customer', 'c_mktsegment', 'BUILDING', 'MACHINERY',
         "json_object('id', id, 'login_name', c_name)")
 .format(id='cast(c_custkey as varchar)')}
)
select table_name as topic, key, value from changes
where event_type = 'INSERT' or (table_name = 'user_info' and event_type = 'UPDATE')
"""


def _share(name: str) -> str:
    return f"""
    with c as (select {name} as name, count(*) as value from ({_MATCHED}) m group by 1)
    select name, value, round(value * 100.0 / (select sum(value) from c), 2) as share
    from c
    """


_EVENT_FIELDS = f"""
  json_extract_string(props, '$.k') as mid, cast(user_id as varchar) as uid,
  epoch_us(ts) // 1000 as ts, {_day('ts')} as log_date, {_hour('ts')} as log_hour
"""

ORACLES = {
    "dau_first": f"select {_LOG_ROWS} from ({_FIRSTS}) f",
    "dau_total": f"""
        select {_day('ts')} as log_date, count(distinct user_id) as dau
        from events group by 1""",
    "dau_hourly": f"""
        select log_date, log_hour, count(*) as dau from ({_FIRSTS}) f group by 1, 2""",
    "dau_compare": _compare(_DAU_HOURS),
    "amount_compare": _compare(_AMOUNT_HOURS),
    "new_devices": f"""
        select d as log_date, count(*) as new_devices
        from (select min({_day('ts')}) as d from events group by user_id) f group by 1""",
    "dedup_incremental": f"""
        select {_LOG_ROWS} from (
          select * from ({_DATED}) e where ts >= timestamp '{batch.SPLIT}'
            and (log_date, user_id) not in (
              select log_date, user_id from ({_DATED}) s
              where ts < timestamp '{batch.SPLIT}')
          qualify row_number() over (partition by log_date, user_id
                                     order by ts, event_id, event_type) = 1) f""",
    "records_per_batch": """
        select epoch_us(ts) // 3600000000 * 3600 as batch_start, count(*) as records
        from events group by 1""",
    "order_prepare": f"""
        select o_orderkey as id, substr(o_orderpriority, 1, 4) || '*******' as consignee_tel,
               {_day('o_orderdate')} as create_date, {_hour('o_orderdate')} as create_hour,
               o_totalprice as total_amount
        from orders""",
    "gmv_total": f"""
        select {_day('o_orderdate')} as create_date, {_MONEY.format('o_totalprice')} as amount
        from orders group by 1""",
    "gmv_hourly": f"""
        select day as create_date, hour as create_hour, value as amount
        from ({_AMOUNT_HOURS}) h""",
    "phone_mask": """
        select c_custkey, substr(c_name, 1, 4) || '*******' as masked from customer""",
    "sale_detail": _with_users(_sales(_DETAILS)),
    "sale_detail_ttl": _sales(
        _DETAILS,
        "d.detail_time between o.order_time - interval 100 day"
        " and o.order_time + interval 100 day",
    ),
    "sale_detail_unique": f"""
        select order_detail_id, order_id, user_id, sku_price
        from ({_sales(f'select distinct * from ({_DETAILS}) a')}) s""",
    "user_age": f"""
        select o_orderkey, {_age('cast(o_orderdate as date)')} as age from orders""",
    "latest_user": """
        select user_id, event_id, event_type, epoch_us(ts) as ts_us from events
        qualify row_number() over (partition by user_id
                                   order by ts desc, event_id desc) = 1""",
    "enrich_left": f"""
        with o as (
            select * replace (if(id % 7 = 0, -user_id, user_id) as user_id) from ({_ORDERS}) a)
        select o.id as order_id, o.user_id, u.user_gender,
               coalesce(u.age, 0) as user_age, u.user_level, o.dt
        from o left join ({_USERS}) u on o.user_id = u.user_id""",
    "coupon_alert": _alerts(batch.DAY_RULE),
    "coupon_alert_fine": _alerts(batch.FINE_RULE),
    "alert_members": _members(batch.DAY_RULE),
    "alert_documents": _DOCUMENTS,
    "event_parse": f"""
        select {_EVENT_FIELDS}, event_type as evid,
               cast(cast(floor(value) as integer) as varchar) as itemid
        from events""",
    "startup_parse": f"""
        select {_EVENT_FIELDS}, 'startup' as type from events
        where event_type = 'signup'""",
    "order_parse": f"""
        select cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as user_id,
               o_orderstatus as order_status,
               substr(o_orderpriority, 1, 4) || '*******' as consignee_tel,
               o_totalprice as total_amount,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as create_time,
               {_day('o_orderdate')} as create_date, {_hour('o_orderdate')} as create_hour
        from orders""",
    "detail_parse": f"""
        select {_DETAIL_ID} as id, cast(l_orderkey as varchar) as order_id,
               cast(l_partkey as varchar) as sku_id, l_extendedprice as sku_price
        from lineitem""",
    "user_parse": f"""
        select cast(c_custkey as varchar) as id, c_name as login_name,
               cast(c_nationkey as varchar) as user_level,
               {_day("(date '2008-01-01' - cast(floor(c_acctbal) as integer))")} as birthday,
               c_mktsegment as gender
        from customer""",
    "quarantine_split": """
        select event_type = 'error' as bad, count(*) as lines,
               count(case when event_type <> 'error' then 1 end) as with_device
        from events group by 1""",
    "log_route": f"""
        with stamped as (
            select event_type, json_extract_string(props, '$.k') as mid,
                   '{{"evid":"' || event_type || '","itemid":' || cast(floor(value) as integer)
                   || coalesce(',"mid":"' || json_extract_string(props, '$.k') || '"', '')
                   || ',"type":"' || if(event_type = 'signup', 'startup', 'event')
                   || '","uid":"' || user_id || '","ts":{batch.CLOCK_MS}}}' as value
            from events)
        select case when event_type = 'signup' then 'startup_log' else 'event_log' end as topic,
               count(*) as records, count(mid) as keyed,
               cast({batch.CLOCK_MS} as bigint) as min_ts,
               cast({batch.CLOCK_MS} as bigint) as max_ts,
               min(value) as min_value, max(value) as max_value
        from stamped group by 1""",
    "cdc_route": _CDC,
    "kpi_cards": f"""
        select 'dau' as id, '新增日活' as name,
               cast(count(distinct user_id) as double) as value
        from events where {_day('ts')} = '{batch.DAY}'
        union all
        select 'new_mid', '新增设备', cast(count(*) as double)
        from (select min({_day('ts')}) as d from events group by user_id) f
        where d = '{batch.DAY}'
        union all
        select 'order_amount', '新增交易额', {_MONEY.format('value')}
        from events where event_type = 'purchase' and {_day('ts')} = '{batch.DAY}'""",
    "sale_search": f"""
        select * from ({_MATCHED}) m order by order_detail_id, sku_price
        limit {batch.PAGE_SIZE} offset {(batch.PAGE - 1) * batch.PAGE_SIZE}""",
    "sale_search_day": f"""
        select * from ({_with_users(_sales(_NAMED_DETAILS))}) m
        where dt = '{batch.SEARCH_DAY}'""",
    "sale_search_deep": f"""
        select * from ({_MATCHED}) m
        where (order_detail_id, sku_price) > ('{batch.DEEP_AFTER[0]}', {batch.DEEP_AFTER[1]})
        order by order_detail_id, sku_price limit {batch.PAGE_SIZE}""",
    "sale_search_total": f"select count(*) as total from ({_MATCHED}) m",
    "gender_share": _share("user_gender"),
    "age_share": _share(
        "case when user_age < 20 then '20岁以下' when user_age < 30 then '20-30岁'"
        " else '30岁以上' end"
    ),
    "region_volume": f"""
        select n_name as region, count(*) as orders, {_MONEY.format('o_totalprice')} as amount
        from orders join customer on o_custkey = c_custkey
                    join nation on c_nationkey = n_nationkey
        group by 1""",
    "order_volume": f"""
        select o_orderpriority as region, count(*) as orders,
               {_MONEY.format('o_totalprice')} as amount
        from orders group by 1""",
}

# A streamed alert is final once the watermark has passed its window.
_CLOSED = f"""
  window_end <= (
    select epoch_us(max(ts)) // 1000 - {stream.LATENESS_HOURS} * 3600000 from events)
"""

ORACLES.update({
    "stream_first_seen": ORACLES["dau_first"],
    "stream_sale_detail": ORACLES["sale_detail_ttl"],
    "stream_latest_user": ORACLES["latest_user"],
    "stream_coupon_alert": _alerts(batch.DAY_RULE, _CLOSED),
    "stream_alert_members": _members(batch.DAY_RULE, _CLOSED),
})

def _slot(column: str, cuts: tuple[str, ...]) -> str:
    return " + ".join(f"({column} >= timestamp '{cut}')::int" for cut in cuts) + " + 1"


_WATERMARK = f"""
  select least((select max(o_orderdate) from orders), {{other}})
         - interval {stream.SALE_LATENESS} as w
"""

# Buyers come at a time made from their id.
_LATE_USERS = f"""
  with u as (
    select *, timestamp '1995-01-01' + to_days((user_id * 37 % 2400)::int) as came
    from ({_USERS}) u),
  mark as ({_WATERMARK.format(other='(select max(came) from u)')}),
  met as (
    select o.*, u.user_gender, u.age, u.user_level, u.user_id is not null as known
    from ({_ORDERS}) o left join u on o.user_id = u.user_id
      and u.came <= o.order_time + interval {stream.LATE_WAIT}
      and u.came >= o.order_time - interval {stream.LATE_REACH})
  select id as order_id, user_id, user_gender, coalesce(age, 0) as user_age, user_level, dt
  from met where known or order_time + interval {stream.LATE_WAIT} < (select w from mark)
"""

ORACLES.update({
    "stream_alert_replay": ORACLES["stream_coupon_alert"],
    "stream_sale_expiry": ORACLES["sale_detail_ttl"],
    "stream_sale_state": f"""
        with mark as ({_WATERMARK.format(other='(select max(l_shipdate) from lineitem)')}),
        held as (
            select 'left' as side, o_orderdate as t from orders
            union all select 'right', l_shipdate from lineitem)
        select side, count(*) as rows, {_day('min(t)')} as oldest from held, mark
        where t >= w - interval {stream.SALE_TTL} group by side""",
    "stream_batch_counts": f"""
        with firsts as ({_FIRSTS})
        select ({_slot('ts', stream.EVENT_CUTS)})::int as nth, 'log_records' as name,
               count(*) as records
        from events group by 1
        union all
        select ({_slot('ts', stream.EVENT_CUTS)})::int, 'first_records', count(*)
        from firsts group by 1""",
    "stream_dau_hours": ORACLES["dau_hourly"],
    "stream_amount_hours": ORACLES["gmv_hourly"],
    "stream_change_order": f"""
        select 'people' as topic, user_id::varchar as key, event_id::varchar as event_id,
               row_number() over (partition by user_id order by
                   {_slot('ts', stream.EVENT_CUTS)}, event_id)::int as nth
        from events""",
    "stream_late_users": _LATE_USERS,
    "keyed_latest_user": ORACLES["latest_user"],
    "keyed_buyers": f"""
        select o.id as order_id, o.user_id, u.user_gender, coalesce(u.age, 0) as user_age,
               u.user_level, o.dt
        from ({_ORDERS}) o left join ({_USERS}) u on o.user_id = u.user_id
        where o.dt = '{batch.SEARCH_DAY}'""",
    "keyed_amount_hours": f"""
        select {_day('ts')} as create_date, {_hour('ts')} as create_hour, count(*) as records,
               {_MONEY.format('value')} as amount
        from events where event_type = 'purchase' group by 1, 2""",
})
