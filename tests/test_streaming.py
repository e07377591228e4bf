"""Streaming jobs: goldens, and the same rows as the batch operators."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tests import goldens as g
from tillstream.operators import alerts, dedup
from tillstream.operators.routing import Topics
from tillstream.sources.streams import file_stream, read_lines
from tillstream.sources.tables import read_latest, read_table, roll_up, write_batch
from tillstream.streaming import jobs, metrics
from tillstream.streaming.alerts import read_alerts, read_members
from tillstream.streaming.hours import read_days, read_hours, with_hours
from tillstream.streaming.sales import join_late_users, join_streams

ONE_FILE = {"maxFilesPerTrigger": "1"}
STORED = {"written_at", "writer", "batch_id"}


def finish(query):
    query.awaitTermination(240)
    assert not query.isActive
    assert query.exception() is None
    return query


def run(job, *args, name, tmp_path, **more):
    return finish(job(
        *args, name=name, trigger=jobs.ALL_AVAILABLE,
        checkpoint=str(tmp_path / f"cp-{name}"), **more,
    ))


def dau_keys(df):
    return {(r.logDate, r.mid, r.ts) for r in df.collect()}


def test_active_devices_emit_once(spark, feed, tmp_path):
    lines = file_stream(spark, feed("in", *g.FIRST_FILES), ONE_FILE)
    path = str(tmp_path / "dau")
    query = run(jobs.active_device_job, lines, path, name="dau", tmp_path=tmp_path)
    table = read_table(spark, path)
    assert table.count() == 5
    assert dau_keys(table) == g.FIRST_STREAM
    assert set(table.columns) == set(jobs.schemas.DAU_COLUMNS) | STORED
    counts = [
        p.observedMetrics["startup_records"].records
        for p in query.recentProgress if p.observedMetrics
    ]
    assert sum(counts) == 7


def test_active_devices_batch(spark, feed):
    lines = read_lines(spark, feed("in", *g.FIRST_FILES))
    rows = jobs.startup_rows(lines)
    first = dedup.first_record(
        rows.select(*jobs.schemas.DAU_COLUMNS), ["logDate", "mid"], ["ts"]
    )
    assert dau_keys(first) == g.FIRST_BATCH


def test_active_devices_upper_names(spark, feed, tmp_path):
    path = str(tmp_path / "dau")
    run(jobs.active_device_job, file_stream(spark, feed("in", *g.FIRST_FILES)), path,
        upper=True, name="upper", tmp_path=tmp_path)
    table = read_table(spark, path)
    assert set(table.columns) == {c.upper() for c in jobs.schemas.DAU_COLUMNS} | STORED
    assert {r.LOGDATE for r in table.collect()} == {"2021-01-11", "2021-01-12", "2021-01-14"}


def test_active_devices_resume(spark, feed, tmp_path):
    """A restart from the checkpoint remembers what was emitted."""
    folder = feed("in", *g.FIRST_FILES[:1])
    path = str(tmp_path / "dau")
    run(jobs.active_device_job, file_stream(spark, folder), path, name="r", tmp_path=tmp_path)
    for i, rows in enumerate(g.FIRST_FILES[1:], 1):
        with open(f"{folder}/more-{i}.json", "w") as out:
            out.write("\n".join(rows) + "\n")
        run(jobs.active_device_job, file_stream(spark, folder), path, name="r", tmp_path=tmp_path)
    assert dau_keys(read_table(spark, path)) == g.FIRST_STREAM


def alert_keys(df):
    return {(r.doc_id, r.window_end, r.users, r.items, r.events) for r in df.collect()}


def test_alerts_stream(spark, feed, tmp_path):
    cut = len(g.ALERT_LINES) // 2
    folder = feed(
        "in", g.ALERT_LINES[:cut], g.ALERT_LINES[cut:],
        g.ALERT_CLOSING[:1], g.ALERT_CLOSING[1:],
    )
    path = str(tmp_path / "alerts")
    run(jobs.alert_job, file_stream(spark, folder, ONE_FILE), path,
        lateness="60 seconds", name="alerts", tmp_path=tmp_path)
    table = read_alerts(spark, path)
    assert alert_keys(table) == g.ALERTS
    events = jobs.event_rows(read_lines(spark, folder))
    pieces = alerts.alert_pieces(events)
    listed = alerts.alert_members(alerts.alerts_from(pieces), pieces)
    assert sorted(map(tuple, read_members(spark, path).collect())) == sorted(
        map(tuple, listed.collect()))
    assert {r.alert_date for r in table.collect()} == {"2021-01-11"}


def test_alerts_batch(spark, feed):
    events = jobs.event_rows(read_lines(spark, feed("in", g.ALERT_LINES, g.ALERT_CLOSING)))
    assert alert_keys(alerts.coupon_alerts(events)) == g.ALERTS


def _timed(rows, names):
    return [json.dumps(dict(zip(names, r))) for r in rows]


def test_sale_join_ttl(spark, feed):
    """±100 s around the order, in either arrival order, each pair once."""
    base = g.ms(g.BASE)
    orders = feed("orders", _timed(
        [("1", base), ("2", base)], ("id", "t")
    ))
    details = feed("details", _timed([
        ("a", "1", base + 90_000), ("b", "2", base + 150_000),
        ("c", "1", base - 100_000), ("a", "1", base + 91_000),
    ], ("id", "order_id", "t")))

    def stream(folder, fields, time_name):
        rows = spark.readStream.schema(fields).json(folder)
        return rows.withColumn(time_name, F.timestamp_millis("t")).drop("t")

    o = stream(orders, "id string, t long", "order_time").select(
        "id", "order_time", F.lit("1").alias("order_status"), F.lit("x").alias("create_time"),
        F.lit("u").alias("user_id"), F.lit("d").alias("create_date"),
    )
    d = stream(details, "id string, order_id string, t long", "detail_time").select(
        "id", "order_id", "detail_time", F.lit("s").alias("sku_id"),
        F.lit("1.5").alias("order_price"), F.lit("n").alias("sku_name"),
    )
    query = (
        join_streams(o, d, lateness="300 seconds", salts=3)
        .writeStream.format("memory").queryName("ttl_pairs")
        .trigger(availableNow=True).start()
    )
    finish(query)
    pairs = sorted((r.order_id, r.order_detail_id)
                   for r in spark.table("ttl_pairs").collect())
    assert pairs == [("1", "a"), ("1", "c")]


def test_sale_job(spark, feed, tmp_path):
    users = str(tmp_path / "user_table")
    now = time.time()
    run(jobs.user_job, file_stream(spark, feed(
        "users", [g.user("5"), g.user("6", gender="M")], [g.user("5", user_level="3")],
    ), ONE_FILE), users, name="users", tmp_path=tmp_path)
    path = str(tmp_path / "sales")
    run(
        jobs.sale_job,
        file_stream(spark, feed("orders", [g.order("1"), g.order("2", user="99"), g.order("1")], start=now)),
        file_stream(spark, feed("details", [
            g.detail("10", "1"), g.detail("11", "1", order_price="x"),
            g.detail("12", "2"), g.detail("13", "3"), g.detail("10", "1"),
        ], start=now - 30)),
        lambda: read_latest(spark, users, ["id"], ["seq"]),
        path, as_of="2021-01-12", name="sales", tmp_path=tmp_path,
    )
    rows = {r.order_detail_id: r for r in read_table(spark, path).collect()}
    assert set(rows) == {"10", "11", "12"} and read_table(spark, path).count() == 3
    known, unknown = rows["10"], rows["12"]
    assert (known.user_gender, known.user_age, known.user_level) == ("F", 31, "3")
    assert (unknown.user_gender, unknown.user_age, unknown.user_level) == (None, 0, None)
    assert known.sku_price == 2220.0 and rows["11"].sku_price is None
    assert known.dt == "2021-01-09"


def test_order_job_quarantine(spark, feed, tmp_path):
    lines = file_stream(spark, feed(
        "in",
        [g.order("1"), "not json", g.order("2", create_time="2021-01-09")],
        [g.order("3", total_amount="abc"), g.order("4", consignee_tel=None)],
    ), ONE_FILE)
    path, quarantine = str(tmp_path / "orders"), str(tmp_path / "bad")
    run(jobs.order_job, lines, path, quarantine, name="orders", tmp_path=tmp_path)
    rows = {r.id: r for r in read_table(spark, path).collect()}
    assert set(rows) == {"1", "4"}
    assert rows["1"].consignee_tel == "1374*******" and rows["4"].consignee_tel is None
    assert (rows["1"].create_date, rows["1"].create_hour) == ("2021-01-09", "05")
    assert rows["1"].total_amount == 59.0
    assert read_table(spark, quarantine).count() == 3


def test_quarantine_job(spark, feed, tmp_path):
    lines = file_stream(spark, feed("in", [g.startup("m1", 1), "{", '{"mid": "m2"}']))
    path = str(tmp_path / "bad")
    run(jobs.quarantine_job, lines, jobs.schemas.STARTUP_LOG, ("mid", "ts"), path,
        name="q", tmp_path=tmp_path)
    assert {r.value for r in read_table(spark, path).collect()} == {"{", '{"mid": "m2"}'}


def test_log_router_job(spark, feed, tmp_path):
    lines = file_stream(spark, feed("in", [
        g.startup("m1", 1), g.event("m1", 1, "coupon", 2, 0), '{"mid": "m3"}', "junk",
    ]))
    path = str(tmp_path / "topics")
    run(jobs.log_router_job, lines, path, name="router", tmp_path=tmp_path)
    rows = read_table(spark, path).collect()
    assert sorted((r.topic, r.key) for r in rows) == [
        ("event_log", "m1"), ("event_log", "m3"), ("startup_log", "m1"),
    ]
    stamped = json.loads(next(r.value for r in rows if r.topic == "startup_log"))
    assert abs(int(stamped["ts"]) - time.time() * 1000) < 600_000
    # A routed topic is again a feed.
    startup = read_table(spark, path).where("topic = 'startup_log'").select("value")
    assert jobs.startup_rows(startup).first().mid == "m1"


def change(table, kind, *rows, entry="ROWDATA"):
    return json.dumps({
        "entry_type": entry, "table_name": table, "event_type": kind,
        "row_datas": [{"after": r} for r in rows],
    })


CHANGES = [
    change("order_info", "INSERT", {"id": "1"}, {"id": "2"}),
    change("order_info", "UPDATE", {"id": "1"}),
    change("order_detail", "INSERT", {"id": "9", "order_id": "1"}),
    change("user_info", "INSERT", {"id": "5"}),
    change("user_info", "UPDATE", {"id": "5", "gender": "M"}),
    change("user_info", "DELETE", {"id": "5"}),
    change("sku_info", "INSERT", {"id": "7"}),
    change("order_info", "INSERT", {"id": "3"}, entry="TRANSACTIONEND"),
]


def test_change_router_job(spark, feed, tmp_path):
    lines = file_stream(spark, feed("in", CHANGES))
    path = str(tmp_path / "topics")
    topics = Topics(user="people")
    run(jobs.change_router_job, lines, path, topics=topics, name="cdc", tmp_path=tmp_path)
    rows = sorted((r.topic, r.key) for r in read_table(spark, path).collect())
    assert rows == [
        ("order_detail", "9"), ("order_info", "1"), ("order_info", "2"),
        ("people", "5"), ("people", "5"),
    ]


def test_console_job(spark, feed, tmp_path, capfd):
    lines = file_stream(spark, feed("in", ["hello"]))
    run(jobs.console_job, lines.select("value"), 5, name="console", tmp_path=tmp_path)
    assert "hello" in capfd.readouterr().out


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", "d1"), ("b", "d2")], "id string, d string")
    write_batch(first, path, 0, ["d"], "w")
    write_batch(first.limit(0), path, 1, ["d"], "w")
    write_batch(spark.createDataFrame([("a", "d1")], "id string, d string"), path, 1, ["d"], "w")
    write_batch(first, path, 0, ["d"], "w")
    assert read_table(spark, path).count() == 3
    assert read_latest(spark, path, ["id"]).count() == 2
    # Another writer's batch of the same number adds.
    write_batch(first, path, 0, ["d"], "v")
    assert read_table(spark, path).count() == 5
    target = str(tmp_path / "rolled")
    roll_up(spark, path, target, ["id"], partition_by=["d"])
    assert sorted((r.id, r.d) for r in read_table(spark, target).collect()) == [
        ("a", "d1"), ("b", "d2"),
    ]
    write_batch(first, target, 0, ["d"], "w")
    assert read_table(spark, target).count() == 4
    assert read_latest(spark, target, ["id"]).count() == 2


def test_new_checkpoint_adds(spark, feed, tmp_path):
    """A second query on the same table starts at batch 0 and erases nothing."""
    path = str(tmp_path / "orders")
    for i in ("1", "2"):
        lines = file_stream(spark, feed(f"in{i}", [g.order(i)]))
        finish(jobs.order_job(lines, path, str(tmp_path / "bad"), name=f"o{i}",
                              trigger=jobs.ALL_AVAILABLE, checkpoint=str(tmp_path / f"c{i}")))
    assert {r.id for r in read_table(spark, path).collect()} == {"1", "2"}


def test_two_jobs_share_a_quarantine(spark, feed, tmp_path):
    bad = str(tmp_path / "bad")
    run(jobs.order_job, file_stream(spark, feed("a", ["x"])), str(tmp_path / "o"), bad,
        name="orders", tmp_path=tmp_path)
    run(jobs.user_job, file_stream(spark, feed("b", ["y"])), str(tmp_path / "u"), bad,
        name="users", tmp_path=tmp_path)
    assert {r.value for r in read_table(spark, bad).collect()} == {"x", "y"}


def test_the_last_line_of_a_file_wins(spark, feed, tmp_path):
    users = str(tmp_path / "user_table")
    lines = feed("in", [g.user("5", user_level="3"), g.user("5", user_level="1")])
    run(jobs.user_job, file_stream(spark, lines), users, name="users", tmp_path=tmp_path)
    assert [r.user_level for r in read_latest(spark, users, ["id"], ["seq"]).collect()] == ["1"]


def test_day_filters_prune_current_rows(spark, feed, tmp_path):
    path = str(tmp_path / "orders")
    run(jobs.order_job, file_stream(spark, feed("in", [g.order("1")])), path,
        name="orders", tmp_path=tmp_path)
    day = read_latest(spark, path, ["create_date", "id"]).where("create_date = '2021-01-09'")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(create_date" in plan and day.count() == 1


@pytest.mark.parametrize("ts", ["9223372036854775807", "-9223372036854775808"])
def test_times_out_of_range_do_not_stop_a_stream(spark, feed, tmp_path, ts):
    poison = '{"mid": "m9", "ts": %s}' % ts
    lines = feed("in", [g.startup("m1", 1), poison], [g.startup("m2", 2)])
    path, bad = str(tmp_path / "dau"), str(tmp_path / "bad")
    run(jobs.active_device_job, file_stream(spark, lines, ONE_FILE), path, quarantine=bad,
        name="dau", tmp_path=tmp_path)
    for query in spark.streams.active:
        finish(query)
    assert {r.mid for r in read_table(spark, path).collect()} == {"m1", "m2"}
    assert [r.value for r in read_table(spark, bad).collect()] == [poison]


def test_repeated_keys_do_not_stop_the_router(spark, feed, tmp_path):
    lines = feed("in", ['{"mid": "a", "mid": "b", "n": 5, "o": {"p": [1]}}', "junk"],
                 [g.startup("m1", 1)])
    path, bad = str(tmp_path / "topics"), str(tmp_path / "bad")
    run(jobs.log_router_job, file_stream(spark, lines, ONE_FILE), path, quarantine=bad,
        name="router", tmp_path=tmp_path)
    values = {r.key: json.loads(r.value) for r in read_table(spark, path).collect()}
    assert set(values) == {"b", "m1"} and isinstance(values["b"].pop("ts"), int)
    assert values["b"] == {"mid": "b", "n": 5, "o": {"p": [1]}}
    assert [r.value for r in read_table(spark, bad).collect()] == ["junk"]


def test_unreadable_changes_are_kept(spark, feed, tmp_path):
    path, bad = str(tmp_path / "topics"), str(tmp_path / "bad")
    run(jobs.change_router_job, file_stream(spark, feed("in", [*CHANGES[:1], "{broken"])), path,
        quarantine=bad, name="cdc", tmp_path=tmp_path)
    assert read_table(spark, path).count() == 2
    assert [r.value for r in read_table(spark, bad).collect()] == ["{broken"]


def test_failed_write_is_retried(spark, feed, tmp_path):
    """A sink error fails the query; the restart writes the batch once."""
    folder = feed("in", ["one", "two"])
    path = str(tmp_path / "out")
    calls = []

    def flaky(batch, batch_id):
        calls.append(batch_id)
        write_batch(batch.select("value"), path, batch_id)
        if len(calls) == 1:
            raise RuntimeError("store is down")

    def go():
        return jobs.start(
            file_stream(spark, folder), "flaky", flaky,
            trigger=jobs.ALL_AVAILABLE, checkpoint=str(tmp_path / "cp"),
        )

    with pytest.raises(Exception):
        go().awaitTermination(120)
    finish(go())
    assert calls == [0, 0]
    assert sorted(r.value for r in read_table(spark, path).collect()) == ["one", "two"]


def test_kafka_needs_its_package(spark):
    """Without the connector the source fails at once, naming it."""
    from pyspark.errors import AnalysisException

    from tillstream.sources.streams import kafka_stream

    with pytest.raises(AnalysisException, match="(?i)kafka"):
        kafka_stream(spark, "localhost:1", "startup_log")


def test_alerts_come_without_a_later_record(spark, feed, tmp_path):
    """The last record's watermark closes windows long before it; nothing follows."""
    folder = feed("in", g.ALERT_LINES, g.ALERT_CLOSING[:1])
    path = str(tmp_path / "alerts")
    run(jobs.alert_job, file_stream(spark, folder, ONE_FILE), path,
        lateness="60 seconds", name="alerts", tmp_path=tmp_path)
    assert alert_keys(read_alerts(spark, path)) == g.ALERTS


def test_a_window_is_closed_by_the_watermark_alone(spark, feed, tmp_path):
    """A feed that ends a minute after its records: windows up to then are out,
    though no slide step between them holds a record."""
    end = max(json.loads(line)["ts"] for line in g.ALERT_LINES)
    late = json.dumps({**json.loads(g.ALERT_LINES[-1]), "mid": "m9", "ts": end + 71_000})
    path = str(tmp_path / "alerts")
    run(jobs.alert_job, file_stream(spark, feed("in", g.ALERT_LINES, [late]), ONE_FILE), path,
        lateness="10 seconds", name="alerts", tmp_path=tmp_path)
    steps = read_table(spark, f"{path}/steps")
    closed = (end + 61_000) // 5_000 * 5_000
    assert steps.where("kind = 'clock'").agg(F.max("at")).first()[0] == closed
    assert steps.where("kind <> 'clock'").agg(F.max("at")).first()[0] <= end + 5_000


def test_batch_counts_are_stored(spark, feed, tmp_path):
    counts = metrics.BatchCounts(spark, str(tmp_path / "counts"))
    spark.streams.addListener(counts)
    try:
        query = run(jobs.active_device_job, file_stream(spark, feed("in", *g.FIRST_FILES), ONE_FILE),
                    str(tmp_path / "dau"), name="dau", tmp_path=tmp_path)
        counts.wait(query.runId)
    finally:
        spark.streams.removeListener(counts)
    rows = metrics.batch_counts(spark, str(tmp_path / "counts")).collect()
    assert {r.query for r in rows} == {str(query.id)}
    total = {name: sum(r.records for r in rows if r.name == name)
             for name in ("startup_records", "new_records")}
    assert total == {"startup_records": 7, "new_records": 5}
    assert sorted(r.nth for r in rows if r.name == "startup_records") == [1, 2, 3]


def test_hours_beside_the_detail(spark, feed, tmp_path):
    path, hours = str(tmp_path / "orders"), str(tmp_path / "hours")
    lines = feed("in", [g.order("1"), g.order("2", total_amount="0.1")],
                 [g.order("3", total_amount="0.2", create_time="2021-01-09 06:00:00")])
    run(jobs.order_job, file_stream(spark, lines, ONE_FILE), path, hours=hours, name="orders",
        tmp_path=tmp_path)
    assert {tuple(r) for r in read_hours(spark, hours).collect()} == {
        ("2021-01-09", "05", 2, 59.1), ("2021-01-09", "06", 1, 0.2)}
    assert [tuple(r) for r in read_days(spark, hours).collect()] == [("2021-01-09", 3, 59.3)]
    # A batch that was stored but not yet counted is counted by its retry, once.
    detail = read_table(spark, path).where("batch_id = 0")
    write = with_hours(lambda rows, number: None, hours, "create_date", "create_hour", "total_amount")
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "another")
    try:
        for _ in range(2):
            write(detail, 0)
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    assert [tuple(r) for r in read_days(spark, hours).collect()] == [("2021-01-09", 5, 118.4)]


def test_a_hot_order_of_updates_stays_in_order(spark, feed, tmp_path):
    """All updates of a user lie in one file a batch, in the order of the feed."""
    folder = feed("in", [change("user_info", "UPDATE", {"id": str(i % 3), "n": str(i)},
                                {"id": str(i % 3), "n": str(i) + "b"}) for i in range(60)])
    path = str(tmp_path / "topics")
    run(jobs.change_router_job, file_stream(spark, folder), path, name="cdc", tmp_path=tmp_path)
    log = read_table(spark, path).select(
        "key", "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("at")).collect()
    for key in "012":
        mine = sorted((r for r in log if r.key == key), key=lambda r: r.at)
        assert len({r.file for r in mine}) == 1
        assert [json.loads(r.value)["n"] for r in mine] == [
            n for i in range(int(key), 60, 3) for n in (str(i), f"{i}b")]


def test_users_upserted_and_looked_up(spark, feed, tmp_path):
    users = jobs.user_table(spark, str(tmp_path / "user_table"), buckets=4)
    run(jobs.user_job, file_stream(spark, feed(
        "users", [g.user("5"), g.user("6", gender="M")], [g.user("5", user_level="3")],
    ), ONE_FILE), "", table=users, name="users", tmp_path=tmp_path)
    assert {r.id: r.user_level for r in users.current().collect()} == {"5": "3", "6": "1"}
    now, path = time.time(), str(tmp_path / "sales")
    run(jobs.sale_job, file_stream(spark, feed("orders", [g.order("1"), g.order("2", user="99")], start=now)),
        file_stream(spark, feed("details", [g.detail("10", "1"), g.detail("12", "2")], start=now)),
        users, path, as_of="2021-01-12", name="sales", tmp_path=tmp_path)
    rows = {r.order_detail_id: (r.user_gender, r.user_level) for r in read_table(spark, path).collect()}
    assert rows == {"10": ("F", "3"), "12": (None, None)}


def test_users_that_come_late(spark, feed, tmp_path):
    """Known before the sale, after it, after the limit, and never."""
    base = g.ms(g.BASE)

    def stream(name, schema, *files):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(feed(name, *files))
        return rows.withColumn("time", F.timestamp_millis("t"))

    sale = "order_id string, user_id string, t long"
    sold = stream("sales", sale, *[
        [json.dumps({"order_id": f"s{u}", "user_id": u, "t": base}) for u in "abcd"],
        [json.dumps({"order_id": "end", "user_id": "z", "t": base + 900_000})]])
    sold = sold.select(
        F.col("order_id").alias("order_detail_id"), "order_id", "user_id",
        *[F.lit("x").alias(c) for c in ("order_status", "create_time", "sku_id", "sku_name", "dt")],
        F.lit(1.0).alias("sku_price"), F.col("time").alias("sale_time"))
    came = stream("users", "id string, t long", [
        json.dumps({"id": "a", "t": base - 50_000}), json.dumps({"id": "b", "t": base + 90_000}),
        json.dumps({"id": "c", "t": base + 200_000})],
        [json.dumps({"id": "y", "t": base + 900_000})])
    came = came.select(
        "id", F.lit("F").alias("gender"), F.lit("1990-01-01").alias("birthday"),
        F.lit("2").alias("user_level"), F.col("time").alias("user_time"))
    query = join_late_users(sold, came, as_of="2021-01-12").writeStream.format("memory").queryName(
        "late_users").trigger(availableNow=True).start()
    finish(query)
    rows = sorted((r.order_id, r.user_gender, r.user_age) for r in spark.table("late_users").collect())
    assert rows == [("sa", "F", 31), ("sb", "F", 31), ("sc", None, 0), ("sd", None, 0)]


def test_a_join_keeps_one_store_a_partition(spark, tmp_path):
    """And goes on from a checkpoint whose join kept four."""
    version = "spark.sql.streaming.join.stateFormatVersion"

    def deliver(low, high):
        for side in "ab":
            spark.range(low, high).select(
                F.col("id").alias(side), F.timestamp_seconds(F.col("id") + 1_000_000).alias(f"{side}_time")
            ).write.mode("append").parquet(str(tmp_path / side))

    def join(name):
        a, b = (spark.readStream.schema(f"{s} long, {s}_time timestamp").parquet(str(tmp_path / s))
                .withWatermark(f"{s}_time", "1 day") for s in "ab")
        met = a.join(b, F.expr("a = b and a_time between b_time - interval 1 day and b_time"))
        query = finish(jobs.start(
            met, name, jobs.table_writer(str(tmp_path / f"{name}-out")),
            trigger=jobs.ALL_AVAILABLE, checkpoint=str(tmp_path / f"{name}-cp")))
        states = [json.loads(p.json)["stateOperators"][0] for p in query.recentProgress]
        found = read_table(spark, str(tmp_path / f"{name}-out")).select("a").collect()
        return {s["numStateStoreInstances"] for s in states}, sorted(r.a for r in found)

    deliver(0, 20)
    assert join("new") == ({4}, list(range(20)))
    assert spark.conf.get(version, None) is None
    spark.conf.set(version, "2")
    try:
        assert join("old") == ({16}, list(range(20)))
    finally:
        spark.conf.unset(version)
    deliver(20, 30)
    assert join("old") == ({16}, list(range(30)))
    assert join("new") == ({4}, list(range(30)))
