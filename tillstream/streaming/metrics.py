"""Record counts of every micro-batch, kept as a table.

Counts are observed on the way through a query (``jobs.counted``) and reported
with the progress of each batch that has succeeded.  A listener stores them, so
a count needs no pass over the data and costs the query nothing.
"""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from tillstream.sources.keyed import KeyedTable

COUNTS = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("batch", T.LongType()),
    T.StructField("name", T.StringType()), T.StructField("records", T.LongType()),
])


def counts_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, COUNTS, ("query", "batch", "name"), buckets=4)


class BatchCounts(StreamingQueryListener):
    """Stores the observed counts of the named queries under ``path``.

    A query is named by the id that its checkpoint keeps, so its batches go on
    counting after a restart, and a batch that is run again counts once.  Add it
    with ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, path: str, ids: set[str] | None = None) -> None:
        self.table = counts_table(spark, path)
        self.ids = ids
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        query = str(progress.id)
        if self.ids is not None and query not in self.ids:
            return
        rows = [(query, progress.batchId, name, int(row["records"]))
                for name, row in progress.observedMetrics.items()
                if row is not None and "records" in row.asDict()]
        if rows:
            batch = self.table.spark.createDataFrame(rows, COUNTS)
            self.table.upsert(batch, query, progress.batchId)

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def wait(self, run_id: str, seconds: float = 60) -> None:
        """Until the counts of an ended run are stored."""
        if not self._ended[str(run_id)].wait(seconds):
            raise TimeoutError(f"the end of run {run_id} was not reported")


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    """``query, nth, batch, name, records``: ``nth`` numbers the batches of a query
    that had records, from 1, however many empty ones lay between."""
    rows = counts_table(spark, path).current()
    busy = rows.groupBy("query", "batch").agg(F.sum("records").alias("n")).where("n > 0")
    # One row per batch of a query.
    order = F.row_number().over(Window.partitionBy("query").orderBy("batch"))
    return rows.join(busy.select("query", "batch", order.alias("nth")), ["query", "batch"]).select(
        "query", "nth", "batch", "name", "records")

