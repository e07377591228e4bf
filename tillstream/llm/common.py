"""What the corpus operators share: tables, the shared scratch folder, label splits."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def quoted(column: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def as_row(docs: DataFrame) -> Column:
    """All columns of a table as one struct, so that no name of theirs can meet
    a name of an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def row_columns(docs: DataFrame, row: str, **instead: Column) -> list[Column]:
    """The columns of ``docs`` from such a struct; some of them from elsewhere."""
    return [instead.get(c, F.col(row)[c]).alias(c) for c in docs.columns]


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as empty text."""
    written = F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")
    return F.crc32(written) % F.lit(modulus)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    That is ``spark.checkpoint.dir``; only where driver and executors are one
    machine may it be unset, and the warehouse stands in for it.  The path is
    removed when the driver's Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all machines share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; the folder belongs to the cluster then
            return

    atexit.register(remove)
    return path


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut, and
    a lost executor costs a read instead of the whole computation.  ``files`` is
    the most that are written; the last step runs in as many tasks at most."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark removes them once the driver has collected the objects that name
    them; this asks for that after steps that shuffle as much as the input.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame, column: str) -> int:
    """Total bytes of a column: one number, summed inside the tasks first."""
    total = df.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"]
    return int(total or 0)
