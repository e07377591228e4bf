"""Merkle manifest of a table: trees of digests with nested-interval labels.

The leaves of a tree are ranked; a node carries the interval ``[lo, hi)`` of the
leaf ranks below it.  Two runs of consecutive nodes make a parent, whose digest
hashes theirs; a last run of one is hashed alone while a level has several
nodes.

Levels are bucketed: ``BITS`` of them make a tier, and a bucket is the subtree
of a tier below one node.  A bucket has at most ``2 ** BITS`` entries, however
large the table or one of its trees is.

* Upwards a tier is one aggregation by bucket; the bucket's top digest is an
  entry of the next tier, so tier after tier is ``2 ** BITS`` times smaller.
* Downwards an entry meets the nodes of its own bucket in a containment join: a
  parent is an ancestor when its interval contains the entry's, and what is left
  of the parent's interval beside the child that contains the entry is the
  sibling.  The path of the bucket itself, found a tier above, follows.

Ranks come from a range partitioning with running counts per partition, so a
tree with most of the rows is ranked by many tasks.  All hashing is done by
built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstream.llm.common import stored

BITS = 4
PATH = "array<struct<level: int, left: boolean, digest: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of text parts written one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def tree_key(column: Column) -> Column:
    """Text key of a tree; the null tree sorts first, the others bytewise."""
    return F.when(column.isNull(), F.lit("")).otherwise(
        F.concat(F.lit("="), column.cast("string")))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its path of siblings give."""
    return F.aggregate(path, leaf, lambda below, step: digest(
        F.when(step["digest"].isNull(), below)
        .when(step["left"], F.concat(step["digest"], below))
        .otherwise(F.concat(below, step["digest"]))))


def siblings(path: Column) -> Column:
    """The sibling digests of a path from the leaf to the root, as one text."""
    return F.array_join(F.transform(path, lambda step: step["digest"]), "")


@dataclass(frozen=True)
class Tree:
    """Trees that are built: ``leaves`` (tree, n, pos, digest and the caller's
    columns), one table of buckets per tier, and ``roots`` (tree, digest)."""

    leaves: DataFrame
    tiers: tuple[DataFrame, ...]
    roots: DataFrame


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows with ``pos``, their rank in their ``tree``, and ``n``, its size.

    Equal rows are ranked one after the other, in any order.
    """
    keys = ["tree", *order, "__tie"]
    placed = stored(
        rows.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
        .drop("__tie"), name)
    runs = placed.groupBy("tree", "__part").agg(
        F.count("*").alias("__n"), F.min("__at").alias("__first"))
    # One row per tree and partition that holds a part of it.
    tree = Window.partitionBy("tree")
    before = F.sum("__n").over(tree.orderBy("__part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    runs = runs.select(
        "tree", "__part", (before - F.col("__first")).alias("__shift"),
        F.sum("__n").over(tree).alias("n"))
    return placed.join(runs, ["tree", "__part"]).withColumn(
        "pos", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


def _parents(nodes: str) -> Column:
    """Digests of every two consecutive nodes; of the last one alone, if odd."""
    return F.transform(
        F.sequence(F.lit(1), F.size(nodes), F.lit(2)),
        lambda i: digest(F.element_at(nodes, i), F.coalesce(F.get(nodes, i), F.lit(""))))


def _buckets(entries: DataFrame, tier: int) -> DataFrame:
    """One row per bucket: ``tree, n, bucket, depth`` and its levels ``d0 .. dBITS``.

    Levels above the top of a tree repeat its root.
    """
    kids = F.array_sort(F.collect_list(F.struct("pos", "digest")))
    table = entries.groupBy(
        "tree", "n", F.shiftright("pos", BITS).alias("bucket")).agg(kids.alias("kids"))
    depth = F.least(F.lit(BITS), F.greatest(F.lit(0), _height(F.col("n")) - BITS * tier))
    table = table.withColumns({
        "depth": depth, "d0": F.transform("kids", lambda kid: kid["digest"])}).drop("kids")
    for h in range(1, BITS + 1):
        table = table.withColumn(
            f"d{h}", F.when(F.col("depth") >= h, _parents(f"d{h - 1}")).otherwise(F.col(f"d{h - 1}")))
    return table


def build(leaves: DataFrame, name: str = "merkle") -> Tree:
    """Trees over ranked leaves; every tier is a stored table."""
    top = leaves.agg(F.max(_height(F.col("n"))).alias("h")).first()["h"] or 0
    entries, tiers = leaves.select("tree", "n", "pos", "digest"), []
    for tier in range(max(1, -(-top // BITS))):
        table = stored(_buckets(entries, tier), f"{name}-{tier}")
        tiers.append(table)
        entries = table.select(
            "tree", "n", F.col("bucket").alias("pos"), F.get(f"d{BITS}", F.lit(0)).alias("digest"))
    return Tree(leaves, tuple(tiers), entries.select("tree", "digest"))


def _tier_nodes(table: DataFrame, tier: int) -> DataFrame:
    """The nodes below a bucket's top, with their own and their parent's interval."""
    unit = 1 << (BITS * tier)
    levels = F.array(*[
        F.struct(F.lit(h).alias("h"), F.lit(unit << h).cast("long").alias("width"),
                 F.col(f"d{h}").alias("row")) for h in range(BITS)])
    rows = table.select("tree", "n", "bucket", "depth", F.explode(levels).alias("at")).where(
        F.col("at.h") < F.col("depth"))
    rows = rows.select("tree", "n", "bucket", F.col("at.h").alias("h"),
                       F.col("at.width").alias("__width"), F.posexplode("at.row"))
    start = F.col("bucket") * (unit << BITS)
    rows = rows.withColumn("__lo", start + F.col("pos") * F.col("__width"))
    parent = F.col("__lo") - F.pmod(F.col("__lo"), F.col("__width") * 2)
    return rows.select(
        "tree", "bucket", (F.col("h") + BITS * tier).alias("level"), F.col("col").alias("digest"),
        F.col("__lo").alias("lo"), F.least(F.col("__lo") + F.col("__width"), F.col("n")).alias("hi"),
        parent.alias("parent_lo"),
        F.least(parent + F.col("__width") * 2, F.col("n")).alias("parent_hi"))


def nodes(tree: Tree) -> DataFrame:
    """Every node: ``tree, level, lo, hi, digest``; leaves have level 0."""
    sizes = tree.leaves.select("tree", "n").distinct()
    found = tree.roots.join(sizes, "tree").select(
        "tree", _height(F.col("n")).alias("level"), F.lit(0).cast("long").alias("lo"),
        F.col("n").alias("hi"), "digest")
    for tier, table in enumerate(tree.tiers):
        found = found.unionByName(
            _tier_nodes(table, tier).select("tree", "level", "lo", "hi", "digest"))
    return found


def _attach(entries: DataFrame, table: DataFrame, tier: int) -> DataFrame:
    """Entries of a tier with the ``steps`` of their path inside the bucket."""
    unit = 1 << (BITS * tier)
    own = entries.columns
    lo = F.col("e.pos") * unit
    hi = F.least(lo + unit, F.col("e.n"))
    ancestor = (F.col("m.parent_lo") <= lo) & (hi <= F.col("m.parent_hi"))
    mine = (F.col("m.lo") <= lo) & (hi <= F.col("m.hi"))
    # The difference of the parent's interval and its child's is empty for a run of one.
    alone = (F.col("m.lo") == F.col("m.parent_lo")) & (F.col("m.hi") == F.col("m.parent_hi"))
    step = F.when(F.col("m.level").isNotNull(), F.struct(
        "m.level", (F.col("m.lo") < lo).alias("left"),
        F.when(~alone, F.col("m.digest")).alias("digest")))
    met = entries.withColumn("bucket", F.shiftright("pos", BITS)).alias("e").join(
        _tier_nodes(table, tier).alias("m"),
        (F.col("e.tree") == F.col("m.tree")) & (F.col("e.bucket") == F.col("m.bucket"))
        & ancestor & (alone | ~mine), "left")
    return met.select("e.*", step.alias("__step")).groupBy("tree", "bucket", *[
        c for c in own if c != "tree"]).agg(
            F.array_sort(F.collect_list("__step")).cast(PATH).alias("__steps"))


def paths(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """The leaves with ``path``, level by level to the root.

    ``above`` has one row per tree: ``tree``, ``path`` (what follows this
    tree's root) and columns to hand down; without it each path ends at the root.
    """
    if above is None:
        above = tree.roots.select(
            "tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    extra = [c for c in above.columns if c not in ("tree", "path")]
    upper = above.withColumn("bucket", F.lit(0).cast("long")).withColumnRenamed("path", "__rest")
    for tier in range(len(tree.tiers) - 1, -1, -1):
        if tier:
            # The entries of a tier are the first level of its buckets.
            entries = tree.tiers[tier].select("tree", "n", "bucket", F.posexplode("d0")).select(
                "tree", "n", (F.col("bucket") * (1 << BITS) + F.col("pos")).alias("pos"))
        else:
            entries = tree.leaves
        found = _attach(entries, tree.tiers[tier], tier).join(upper, ["tree", "bucket"]).withColumn(
            "path", F.concat("__steps", "__rest"))
        if tier:
            upper = found.select(
                "tree", F.col("pos").alias("bucket"), F.col("path").alias("__rest"), *extra)
    return found.select(*tree.leaves.columns, "path", *extra)


def manifest(leaves: DataFrame, order: Sequence[str]) -> tuple[DataFrame, Tree, Tree]:
    """Proofs of every leaf, the trees, and the tree of their roots.

    ``leaves`` has ``tree`` (see ``tree_key``), ``digest``, the columns of
    ``order`` and others to carry, under names of the caller's choice other than
    ``n, pos, bucket, path, subroot, root`` and names that begin with two
    underscores.  A tree's leaves ascend by ``order`` (nulls first); leaves that
    agree in all of it follow one another in any order.  Roots ascend by tree key
    and make one more tree.  The proofs are the leaves with ``pos``, ``path``,
    ``subroot`` and ``root``.  An empty table has no trees and no rows.
    """
    trees = build(ranked(leaves, order, "merkle-leaves"), "merkle-tiers")
    roots = stored(trees.roots, "merkle-roots").select(
        F.lit("").alias("tree"), F.col("tree").alias("child"), "digest")
    top = build(ranked(roots, ["child"], "merkle-subroots"), "merkle-top")
    above = paths(top).select(
        F.col("child").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return paths(trees, above), trees, top


def document_leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, n_chars, digest, changed`` of documents.

    ``changed`` is the digest that the leaf has with one more in ``n_chars``; a
    null stays.  Every column may be null, texts may be empty or of any length,
    rows may repeat; other columns of ``docs`` are not read.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang")]
    text = field(F.col("text"))
    return docs.select(
        tree_key(F.col("lang")).alias("tree"), "doc_id",
        digest(*head, field(F.col("n_chars")), text).alias("digest"),
        digest(*head, field(more), text).alias("changed"))


def prove_documents(docs: DataFrame, tampered: Column) -> DataFrame:
    """Proof and check of every document; ``tampered`` (over ``doc_id``) says
    whose ``n_chars`` has grown by one since the manifest was made.

    Returns ``doc_id, leaf, subroot, root, path, folded_root, verified``, one row
    per row of ``docs``.
    """
    leaves = stored(document_leaves(docs), "merkle-digests")
    proofs, _, _ = manifest(leaves, ["doc_id", "digest"])
    now = F.when(tampered, F.col("changed")).otherwise(F.col("digest"))
    return proofs.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path",
        fold(now, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
