"""Connected components of a links table, without moving it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(
        F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, label) for every node of links (a, b); the label is the smallest
    node of its component.  Null ends and self-links are left out; an empty
    table gives no rows.

    Alternating stars halve the depth of each component in every round; minima
    are taken inside the tasks first, so a node with many neighbours costs a
    row a task.  Each round is written to the shared folder, in at most
    ``files`` files.
    """
    edges = stored(
        links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(),
        "components", files)
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "components", files)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
