"""Message streams: Kafka, or folders of files with the same columns.

Every stream yields ``value`` (text) and ``ingest_time``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_stream(
    spark: SparkSession, servers: str, topic: str, options: dict[str, str] | None = None
) -> DataFrame:
    """A topic from its latest offsets.

    Progress is kept in the query's checkpoint, not in the consumer group.
    Needs the Kafka connector package on the session's class path.
    """
    settings = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "latest",
        **(options or {}),
    }
    return (
        spark.readStream.format("kafka").options(**settings).load()
        .select(
            F.col("value").cast("string").alias("value"),
            F.col("timestamp").alias("ingest_time"),
            "partition",
            "offset",
        )
    )


def file_stream(
    spark: SparkSession, path: str, options: dict[str, str] | None = None
) -> DataFrame:
    """JSON-lines files as they arrive; arrival time is the file's.

    ``file_block`` is where the read block begins in its file.
    """
    return (
        spark.readStream.format("text").options(**(options or {})).load(path)
        .select(
            "value",
            F.col("_metadata.file_modification_time").alias("ingest_time"),
            F.col("_metadata.file_block_start").alias("file_block"),
        )
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same lines as a batch."""
    return spark.read.text(path)
