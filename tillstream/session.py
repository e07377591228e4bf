"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Result-affecting settings first (zone, ANSI), then settings that only steer
# the physical plan.  Shuffle partition counts are left to the cluster / AQE.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A repeated key of a JSON log counts with its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# State on local disk instead of the heap; a join keeps one store a partition
# instead of four, and a write does not read the row before it.
STATE_SETTINGS = {
    STATE_PROVIDER: DEFAULTS[STATE_PROVIDER],
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def build_session(
    app: str = "tillstream",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the library's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for stream checkpoints and staged tables.

    Taken from ``spark.checkpoint.dir``.  Only where driver and executors are one
    machine may it be unset; a folder in the warehouse stands in for it there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all machines share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_streams"


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """The session's settings for state, where it has none of its own, while a
    query starts; a started query keeps them, a resumed one those of its checkpoint.

    With another state store than ours the session is left as it is.
    """
    own = spark.conf.get(STATE_PROVIDER, None)
    with settings(spark, STATE_SETTINGS if own in (None, STATE_SETTINGS[STATE_PROVIDER]) else {}):
        yield


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """These settings, where the session has none of its own, for a while."""
    added = [key for key in wanted if spark.conf.get(key, None) is None]
    for key in added:
        spark.conf.set(key, wanted[key])
    try:
        yield
    finally:
        for key in added:
            spark.conf.unset(key)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of ended queries.

    Spark removes them once the driver has collected the objects that name them;
    this asks for that where a query shuffles as much as its input again and again.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str, keep: bool = False) -> None:
    """Remove a folder with all it has; with ``keep`` it is left empty."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(target, True)
    if keep:
        files.mkdirs(target)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a staged folder when the driver's Python ends."""

    def attempt() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder belongs to the cluster then
            return

    atexit.register(attempt)
