"""Keyed tables: one current row per key, in hash buckets, behind a version pointer.

A batch of writes goes to a new *slot*, a folder that holds its rows by bucket.
Which slots make up a bucket is said by a *version*: one small file with one
row, written whole under its final name, so a version is there or not.  Readers
take the last version and read exactly the folders it names; what it does not
name cannot be seen, be it half written, given up or replaced.

* A batch touches the buckets of its keys only; a lookup reads these buckets only.
* ``compact`` folds the slots of a bucket into one.  It writes a new slot and
  then a new version: readers of the earlier version go on reading its slots.
* Slots that none of the last ``VERSIONS`` versions names are written over, so
  the number of folders is bounded by the table's settings, whatever the number
  of batches.
* A version carries the last batch of every writer: a retried batch that was
  already taken changes nothing.

Commits of a table must come from one application, whose queries share a lock
in its driver; readers may be anywhere.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.operators.dedup import latest_record

VERSIONS = 4  # versions that stay readable
RETRIES = 3
BUCKET, SLOT, COMMIT = "_bucket", "_slot", "_commit"
POINTER = "version long, slots map<int, array<int>>, taken map<string, long>"
# Keys of a lookup that are broadcast at most: fixed-width or short text, a few MB.
BROADCAST_KEYS = 100_000

_locks: dict[str, threading.RLock] = defaultdict(threading.RLock)


@dataclass(frozen=True)
class Version:
    number: int = 0
    slots: dict[int, tuple[int, ...]] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)

    def named(self) -> set[int]:
        return {slot for slots in self.slots.values() for slot in slots}


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path``; ``schema`` are its columns, ``keys`` name a row and
    of the rows of a key the largest by ``order``, then the last written, counts.

    ``max_slots`` is the number of slots that a bucket may have before a write
    compacts it.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    buckets: int = 16
    max_slots: int = 8

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # --- versions ------------------------------------------------------------------

    def versions(self) -> list[Version]:
        """The versions that are kept, oldest first."""
        for _ in range(RETRIES):
            try:
                return self._versions()
            except (AnalysisException, SparkRuntimeException):
                continue  # a version was written over between listing and reading
        return self._versions()

    def _versions(self) -> list[Version]:
        reader = self.spark.read.schema(POINTER)
        places = [f"{self.path}/versions/{ring}" for ring in range(VERSIONS)]
        while places:
            try:
                rows = reader.parquet(*places).collect()
                break
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
                places.pop()  # the ring has not come round yet
        else:
            rows = []
        found = [Version(r["version"], {b: tuple(s) for b, s in r["slots"].items()},
                         dict(r["taken"])) for r in rows]
        return sorted(found, key=lambda v: v.number)

    def version(self) -> Version:
        kept = self.versions()
        return kept[-1] if kept else Version()

    def _commit(self, version: Version) -> None:
        """Make a version current.

        Its file takes the place of the version ``VERSIONS`` earlier, which no
        reader that follows the table still uses.
        """
        row = (version.number, {b: list(s) for b, s in version.slots.items()}, version.taken)
        self.spark.createDataFrame([row], POINTER).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/versions/{(version.number - 1) % VERSIONS}")

    def _free_slot(self, kept: list[Version]) -> int:
        used = {slot for version in kept for slot in version.named()}
        return next(i for i in range(len(used) + 1) if i not in used)

    # --- reading -------------------------------------------------------------------

    def _read(self, slots: dict[int, Sequence[int]]) -> DataFrame:
        """Rows of the named slots of the named buckets, and of no other folder."""
        stored = T.StructType([*self.schema.fields, T.StructField(COMMIT, T.LongType())])
        paths = [f"{self.path}/data/{slot}/{BUCKET}={bucket}"
                 for bucket, own in slots.items() for slot in own]
        if not paths:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*paths)

    def _resolved(self, rows: DataFrame) -> DataFrame:
        return latest_record(rows, self.keys, [*self.order, COMMIT])

    def current(self, version: Version | None = None) -> DataFrame:
        """One row per key, as of a version (the last one)."""
        version = version or self.version()
        return self._resolved(self._read(version.slots)).select(*self.schema.fieldNames())

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys of some rows; never more than the table has."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def lookup(self, keys: DataFrame, version: Version | None = None) -> DataFrame:
        """The current rows of some keys (columns named as the table's).

        Only the buckets of these keys are read.  Up to BROADCAST_KEYS different
        keys, counted first, go to the table's files; more than that meet the
        rows of their buckets in a shuffled join.
        """
        version = version or self.version()
        wanted = keys.select(*self.keys).distinct().persist()
        try:
            few = wanted.count() <= BROADCAST_KEYS
            slots = {b: version.slots[b] for b in self.touched(wanted) if b in version.slots}
        finally:
            wanted.unpersist()
        wanted = keys.select(*self.keys).distinct()
        rows = self._read(slots).join(
            F.broadcast(wanted) if few else wanted, list(self.keys), "left_semi")
        return self._resolved(rows).select(*self.schema.fieldNames())

    # --- writing -------------------------------------------------------------------

    def upsert(self, batch: DataFrame, writer: str, batch_id: int) -> bool:
        """Take a batch once; False when it was taken before.

        Rows of one key in a batch are reduced to the last by ``order``.
        """
        with _locks[self.path]:
            kept = self.versions()
            now = kept[-1] if kept else Version()
            if now.taken.get(writer, -1) >= batch_id:
                return False
            rows = latest_record(batch.select(*self.schema.fieldNames()), self.keys, self.order)
            slot, number = self._free_slot(kept), now.number + 1
            self._write(rows.withColumn(COMMIT, F.lit(number).cast("bigint")), slot)
            slots = dict(now.slots)
            for bucket in self._buckets_of(slot):
                slots[bucket] = (*slots.get(bucket, ()), slot)
            self._commit(Version(number, slots, {**now.taken, writer: batch_id}))
            if max(map(len, slots.values()), default=0) > self.max_slots:
                self.compact()
            return True

    def add(self, batch: DataFrame, writer: str, batch_id: int) -> bool:
        """Add a batch's numbers to those of its keys, once; False when it was added before.

        Every column that is no key is a sum; keys that are new begin with the
        batch.  Old and new sums become current together, by one version.
        """
        sums = [f for f in self.schema if f.name not in self.keys]
        with _locks[self.path]:
            now = self.version()
            if now.taken.get(writer, -1) >= batch_id:
                return False
            total = [F.try_sum(f.name).cast(f.dataType).alias(f.name) for f in sums]
            more = batch.groupBy(*self.keys).agg(*total)
            both = self.lookup(more, now).unionByName(more.select(*self.schema.fieldNames()))
            return self.upsert(both.groupBy(*self.keys).agg(*total), writer, batch_id)

    def _write(self, rows: DataFrame, slot: int) -> None:
        (
            rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET)
            .write.mode("overwrite").option("partitionOverwriteMode", "static")
            .partitionBy(BUCKET).parquet(f"{self.path}/data/{slot}")
        )

    def _buckets_of(self, slot: int) -> list[int]:
        """Buckets that a slot holds, by the names of its folders."""
        files = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{slot}").inputFiles()
        return sorted({int(f.rsplit(f"/{BUCKET}=", 1)[1].split("/")[0]) for f in files
                       if f"/{BUCKET}=" in f})

    def compact(self) -> None:
        """Fold the slots of every bucket that has several into one."""
        with _locks[self.path]:
            kept = self.versions()
            now = kept[-1] if kept else Version()
            many = {b: s for b, s in now.slots.items() if len(s) > 1}
            if not many:
                return
            slot = self._free_slot(kept)
            self._write(self._resolved(self._read(many)), slot)
            self._commit(replace(
                now, number=now.number + 1, slots={**now.slots, **{b: (slot,) for b in many}}))


def keyed_writer(table: KeyedTable, writer: str):
    """Batch writer of a stream that keeps a keyed table.

    ``writer`` names the stream in the table; with a new name its batches are
    taken anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, writer, batch_id)

    return write
