"""Benchmark decontamination as a prefix-filtered set join.

Benchmark items are cut into windows of ``window`` words, windows into shingles
of three words.  All shingles of a window must occur in a document that
contains it, so one necessary prefix token is enough: the shingle that is
rarest in the documents.  Documents meet windows only through that token; the
token's place bounds where the window would start and end, and a candidate
counts once all shingles of the window stand there in order, which is exact
containment of its words.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillstream.llm.common import as_row, row_columns, stored, whole_text

# Fixed value: a word is a run of characters other than these.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Words after lower-casing A-Z; ``lower`` does the same where all is ASCII.
    ``split`` reads a text once; ``regexp_extract_all`` copies it for every word."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.array_remove(F.split(lowered, BETWEEN), "")


def shingles(array: Column, size: int) -> Column:
    """Joined runs of ``size`` words at every place; those at the end are shorter."""
    return F.transform(
        array,
        lambda w, i: F.concat_ws(" ", w, *(F.get(array, i + F.lit(j)) for j in range(1, size))),
    )


def marks(array: Column, size: int) -> Column:
    """Hashes of runs of ``size`` words at every place, made without joining them."""
    return F.transform(array, lambda w, i: F.xxhash64(
        w, *(F.get(array, i + F.lit(j)) for j in range(1, size))))


def fits(df: DataFrame, column: str) -> bool:
    """Whether a table is small enough to be broadcast, by its measured size."""
    size = df.agg(
        (F.count("*") * 64 + F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).alias("n")
    ).first()["n"]
    return size <= BROADCAST_BYTES


def small(df: DataFrame, column: str) -> DataFrame:
    """Marked for broadcast if its measured size allows, else left to a
    partitioned join, whose hot keys adaptive execution splits."""
    return F.broadcast(df) if fits(df, column) else df


def places(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(row, total, pos, shingle): where wanted shingles of ``size`` words stand.

    All shingles meet a set too large to be broadcast in a partitioned join.
    """
    placed = docs.select(
        "row", F.size("words").alias("total"),
        F.posexplode(shingles(F.col("words"), size)).alias("pos", "shingle"))
    return placed.where(F.col("pos") + size <= F.col("total")).join(wanted, "shingle", "left_semi")


def marked(docs: DataFrame, wanted: DataFrame, size: int, ends: bool) -> DataFrame:
    """(doc_id, row, total, pos, shingle): places whose hash is that of a wanted
    shingle, which is still to be compared as text.

    With ``ends`` every row of documents adds one row, its end, with ``total`` as
    its place and no shingle, so that words need not be counted in a second pass.
    A broadcast set of hashes comes first: only places that it holds get their
    shingle as text.
    """
    end = F.lit(0).cast("long")
    array = F.split("shingle", " ")
    known = wanted.select(F.xxhash64(*(F.get(array, F.lit(j)) for j in range(SHINGLE))).alias("mark"))
    found = marks(F.col("words"), size)
    here = F.col("pos") + size <= F.col("total")
    if ends:
        known = known.unionByName(docs.sparkSession.range(1).select(end.alias("mark")))
        found = F.concat(found, F.array(end))
        here = here | (F.col("pos") == F.col("total"))
    placed = docs.select(
        "doc_id", "row", "words", F.size("words").alias("total"),
        F.posexplode(found).alias("pos", "mark"))
    met = placed.where(here).join(F.broadcast(known.distinct()), "mark", "left_semi")
    text = F.when(
        F.col("pos") < F.col("total"),
        F.array_join(F.slice("words", F.col("pos") + 1, F.lit(size)), " "))
    return met.select("doc_id", "row", "total", "pos", text.alias("shingle"))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item, window (its words joined), n_words; one row each time it occurs in an item."""
    cut = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        words(whole_text()).alias("words"),
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    return cut.select("item", "words", F.explode(starts).alias("at")).select(
        "item", F.slice("words", F.col("at"), F.lit(window)).alias("words")
    ).select("item", F.array_join("words", " ").alias("window"), F.size("words").alias("n_words"))


def window_shingles(windows: DataFrame) -> DataFrame:
    """window, n_words, off, shingle, n_shingles: the shingles of distinct windows.
    A window of fewer than three words is its own shingle."""
    array = F.split("window", " ")
    size = F.least(F.lit(SHINGLE), F.col("n_words"))
    parts = F.transform(
        F.sequence(F.lit(1), F.col("n_words") - size + 1),
        lambda i: F.array_join(F.slice(array, i, size), " "),
    )
    return windows.select("window", "n_words").distinct().select(
        "window", "n_words", F.posexplode(parts).alias("off", "shingle"),
        (F.col("n_words") - size + 1).alias("n_shingles"),
    )


def row_key() -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64("doc_id", whole_text())


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of documents without any window of the benchmark, with all columns.

    Null and empty texts and items have no words, texts may be of any length,
    equal rows are judged alike and stay rows, columns may have any names and
    hold nulls, and either table may be empty.
    """
    _, found, _ = occurrences(documents, benchmark, window)
    if found is None:
        return documents
    hit = found.select(F.col("row").alias("hit")).distinct()
    named = documents.select(as_row(documents).alias("doc"), row_key().alias("row"))
    return named.join(hit, F.col("row") == F.col("hit"), "left_anti").select(
        *row_columns(documents, "doc"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_hit, n_items, items.

    A window is ``window`` consecutive words of an item (all words of a shorter
    one); n_hit counts the document's words inside any occurrence, items lists
    the items with occurring windows, sorted as strings.  Null and empty texts
    and items have no words; a null item_id is the item ``''``.  Repeated rows
    get equal results, several texts under one doc_id are told apart, either
    table may be empty, and only doc_id, item_id and text are read.
    """
    docs, found, windows = occurrences(documents, benchmark, window)
    if found is None:
        return docs.select("doc_id", "n_words", F.lit(0).alias("n_hit"),
                           F.lit(0).alias("n_items"), F.array().cast("array<string>").alias("items"))
    return counted(docs, found, windows)


def occurrences(documents: DataFrame, benchmark: DataFrame,
                window: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Documents as (doc_id, row, n_words); where windows occur in them as (row,
    start, window, n_words), None without any window; and the items' windows."""
    split = documents.select("doc_id", row_key().alias("row"), words(whole_text()).alias("words"))
    docs = split.select("doc_id", "row", F.size("words").alias("n_words"))
    windows = stored(item_windows(benchmark, window), "windows")
    parts = stored(window_shingles(windows), "window-shingles")
    sizes = [r[0] for r in windows.select(
        F.least(F.lit(SHINGLE), F.col("n_words"))).distinct().collect()]  # at most three numbers

    # Where shingles of the benchmark stand in documents: the one pass that meets all words.
    if not sizes:
        return docs, None, windows
    wanted = parts.select("shingle").distinct()
    if fits(wanted, "shingle"):
        met = [marked(split, wanted, size, ends=not i) for i, size in enumerate(sizes)]
        seen = stored(reduce(DataFrame.unionByName, met), "marked-places")
        docs = seen.where(F.col("pos") == F.col("total")).select(
            "doc_id", "row", F.col("total").alias("n_words"))
        found = seen.where(F.col("pos") < F.col("total")).join(
            F.broadcast(wanted), "shingle", "left_semi")
    else:
        found = reduce(DataFrame.unionByName, [places(split, wanted, size) for size in sizes])
    hits = stored(found.select("shingle", "row", "total", "pos").distinct(), "shingle-hits")

    # Order by rarity over all documents; a window with an absent shingle cannot occur.
    counts = hits.groupBy("shingle").agg(F.count("*").alias("n"))
    prefix = (
        parts.join(counts, "shingle")
        .groupBy("window", "n_words", "n_shingles")
        .agg(F.count("*").alias("present"),
             F.min(F.struct("n", "shingle", "off")).alias("rarest"))
        .where(F.col("present") == F.col("n_shingles"))
        .select("window", "n_words", "n_shingles", "rarest.shingle", "rarest.off")
    )
    candidates = (
        hits.join(small(prefix, "window"), "shingle")
        .withColumn("start", F.col("pos") - F.col("off"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("n_words") <= F.col("total")))
        .select("row", "start", "window", "n_words", "n_shingles")
    )
    size = F.least(F.lit(SHINGLE), F.col("n_words"))
    array = F.split("window", " ")
    expected = candidates.select(
        "*", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.col("n_shingles")),
            lambda i: F.array_join(F.slice(array, i, size), " "),
        )).alias("off", "shingle")
    ).withColumn("pos", F.col("start") + F.col("off"))
    met = stored(
        expected.join(hits.select("row", "pos", "shingle"), ["row", "pos", "shingle"])
        .groupBy("row", "start", "window", "n_words", "n_shingles").agg(F.count("*").alias("met"))
        .where(F.col("met") == F.col("n_shingles"))
        .select("row", "start", "window", "n_words"),
        "occurrences",
    )
    return docs, met, windows


def counted(docs: DataFrame, occurrences: DataFrame, windows: DataFrame) -> DataFrame:
    """Occurrences summed up per row of documents."""
    # Words inside any occurrence: what each adds to the ones that start before it.
    before = Window.partitionBy("row").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1)
    hit = (
        occurrences.groupBy("row", "start").agg(F.max("n_words").alias("n_words"))
        .withColumn("end", F.col("start") + F.col("n_words"))
        .withColumn("from", F.greatest("start", F.max("end").over(before)))
        .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).alias("n_hit"))
    )
    items = (
        occurrences.select("row", "window").distinct()
        .join(windows.select("window", "item").distinct(), "window")
        .select("row", "item").distinct()
        .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    return (
        docs.join(hit.join(items, "row"), "row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
