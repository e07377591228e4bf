"""Keyed tables: upserts, retries, compaction under readers, bounded folders, lookups."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.sources import keyed
from tillstream.sources.keyed import VERSIONS, KeyedTable

SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("name", T.StringType())])


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ("id",), ("seq",), buckets=4, max_slots=3)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(df):
    return {(r.id, r.seq, r.name) for r in df.collect()}


def folders(table):
    root = Path(table.path)
    return (len(list(root.glob("data/*/*"))), len(list(root.glob("versions/*"))))


def test_an_empty_table(table):
    assert content(table.current()) == set() and table.version().number == 0
    assert content(table.lookup(table.current())) == set()
    table.compact()
    assert table.version().number == 0


def test_the_last_of_a_key_counts(spark, table):
    table.upsert(rows(spark, ("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 1, "n")), "w", 0)
    table.upsert(rows(spark, ("a", 1, "late"), ("b", 1, "same"), ("c", None, "c")), "w", 1)
    # A later write wins among equals, an older one by order does not.
    assert content(table.current()) == {
        ("a", 2, "x"), ("b", 1, "same"), ("c", None, "c"), (None, 1, "n")}


def test_a_batch_is_taken_once(spark, table):
    assert table.upsert(rows(spark, ("a", 1, "x")), "w", 5)
    assert not table.upsert(rows(spark, ("a", 9, "y")), "w", 5)
    assert not table.upsert(rows(spark, ("a", 9, "y")), "w", 4)
    assert table.upsert(rows(spark, ("a", 2, "v")), "other", 0)
    assert table.upsert(rows(spark).limit(0), "w", 6)
    assert content(table.current()) == {("a", 2, "v")}


def test_a_write_that_died_is_not_seen(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", 1, "x")), "w", 0)
    commit = KeyedTable._commit
    monkeypatch.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        table.upsert(rows(spark, ("a", 2, "y"), ("b", 1, "z")), "w", 1)
    assert content(table.current()) == {("a", 1, "x")}
    monkeypatch.setattr(KeyedTable, "_commit", commit)
    table.upsert(rows(spark, ("a", 2, "y")), "w", 1)
    assert content(table.current()) == {("a", 2, "y")}


def test_readers_go_on_while_slots_are_folded(spark, table):
    for i in range(3):
        table.upsert(rows(spark, *[(str(k), i, f"v{i}") for k in range(20)]), "w", i)
    before = table.version()
    reader = table.current(before)
    table.compact()
    assert max(map(len, table.version().slots.values())) == 1
    table.upsert(rows(spark, ("0", 9, "new")), "w", 3)
    assert content(reader) == {(str(k), 2, "v2") for k in range(20)}
    assert ("0", 9, "new") in content(table.current())


def test_folders_are_bounded(spark, table):
    """Forty batches leave no more folders than twenty."""
    seen = []
    for i in range(40):
        table.upsert(rows(spark, *[(str(k), i, "v") for k in range(i % 7 + 1)]), "w", i)
        seen.append(folders(table))
    slots = table.buckets + table.max_slots + VERSIONS + 1
    assert max(f[0] for f in seen) <= slots * table.buckets
    assert max(f[0] for f in seen[20:]) == max(f[0] for f in seen)
    assert seen[-1][1] == VERSIONS
    last = {k: max(i for i in range(40) if i % 7 >= k) for k in range(7)}
    assert content(table.current()) == {(str(k), i, "v") for k, i in last.items()}


def files_read(df):
    return {f.rsplit("/data/", 1)[1].split("/part")[0] for f in df.inputFiles()}


def test_a_lookup_reads_the_buckets_of_its_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ("id",), ("seq",), buckets=16)
    table.upsert(rows(spark, *[(str(k), 0, "v") for k in range(500)]), "w", 0)
    wanted = spark.createDataFrame([("7",), ("7",), ("none",)], "id string")
    found = table.lookup(wanted)
    assert content(found) == {("7", 0, "v")}
    (bucket, other) = sorted(table.touched(wanted))
    assert files_read(found) <= {f"0/_bucket={b}" for b in (bucket, other)}
    # The table's side has no exchange between its scan and the join.
    plan = found._jdf.queryExecution().sparkPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line]
    joined = plan[:plan.index("FileScan")].splitlines()
    at = next(i for i, line in enumerate(joined) if "BroadcastHashJoin" in line)
    assert "LeftSemi, BuildRight" in joined[at] and len(scan) == 1
    assert not any("Exchange" in line for line in joined[at + 1:])


def test_many_keys_are_not_broadcast(spark, table, monkeypatch):
    monkeypatch.setattr(keyed, "BROADCAST_KEYS", 1)
    table.upsert(rows(spark, *[(str(k), 0, "v") for k in range(50)]), "w", 0)
    found = table.lookup(spark.range(20).select(F.col("id").cast("string").alias("id")))
    assert "ResolvedHint" not in found._jdf.queryExecution().analyzed().toString()
    assert len(content(found)) == 20


def test_sums_are_added_once(spark, tmp_path):
    schema = "day string, n long, amount decimal(38,10)"
    table = KeyedTable(spark, str(tmp_path / "t"), T._parse_datatype_string(schema), ("day",), buckets=2)

    def batch(*values):
        return spark.createDataFrame(list(values), "day string, n long, amount double").withColumn(
            "amount", F.col("amount").cast("decimal(38,10)"))

    assert table.add(batch(("d1", 1, 0.1), ("d1", 1, 0.2), ("d2", 1, None)), "w", 0)
    assert table.add(batch(("d1", 1, 0.3)), "w", 1)
    assert not table.add(batch(("d1", 1, 0.3)), "w", 1)
    assert {(r.day, r.n, r.amount and float(r.amount)) for r in table.current().collect()} == {
        ("d1", 3, 0.6), ("d2", 1, None)}
