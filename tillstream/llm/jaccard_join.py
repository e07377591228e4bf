"""Near-duplicate classes by an n-gram Jaccard join with T-occurrence search.

A document is its set of distinct word shingles.  Two documents link when their
Jaccard similarity reaches the threshold, for which each must share T of its
shingles with the other.  The steps:

1. Shingles are gathered by hash range, in arrays; a shingle of one text only
   cannot be shared and is dropped, the others return to their texts with the
   number of their holders.
2. Set aside the T - 1 most common shingles of a text: a partner must share one
   of the rest.  Texts meet in the inverted lists of these rare shingles.
3. In every list the text with the smallest set asks for its partners, once for
   all lists that it leads; links give first components.  Lists that still hold
   several components are asked again by all texts outside the list's largest
   component, so a large group of copies needs no pairs among themselves.  Two
   texts need to meet only in the rarest shingle they share, and there sizes and
   places bound what they can share (positional filter).
4. A question is a T-occurrence search (DivideSkip): the lists of the block that
   are short are merged by counting, the long ones probed for those that can
   still reach T.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillstream.llm.common import (
    as_row, input_bytes, release, row_columns, stored, whole_text,
)
from tillstream.llm.graph import components
from tillstream.llm.hashing import shingles

CHUNK_BYTES = 4 << 20
RANGE_BYTES = 12 << 20
BLOCK_BYTES = 8 << 20
LEAST_FILES = 16
SMALL_LIST = 32


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, parted by ASCII white space."""
    return text.encode().lower().split()


def set_of(words: list[bytes], size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(shingles(words, size))


def class_of(words: list[bytes]) -> bytes:
    """Name of a word sequence; texts with the same words are one class."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def needed(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share with any partner: percent of it, rounded up."""
    return -(-n * percent // 100)


def class_rows(docs: DataFrame, size: int) -> DataFrame:
    """(row_id, class, n_shingles) of every row; no class without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                names.append(class_of(words) if words else None)
                sizes.append(len(set_of(words, size)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64())],
                ["row_id", "class", "n_shingles"])

    return docs.mapInArrow(work, "row_id bigint, class binary, n_shingles bigint")


# A payload as suffix_dedup sends it: number of texts, names of the
# texts (8 bytes), how many hashes each has, and the hashes in text order.

def put(names: np.ndarray, counts: np.ndarray, values: np.ndarray) -> bytes:
    return struct.pack("<I", len(names)) + names.tobytes() + counts.astype("<u4").tobytes() + values.tobytes()


def get(payload: bytes, kind: str = "<u8") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", payload)[0]
    names = np.frombuffer(payload, "<u8", n, 4)
    counts = np.frombuffer(payload, "<u4", n, 4 + 8 * n)
    return names, counts.astype(np.int64), np.frombuffer(payload, kind, offset=4 + 12 * n)


# A payload holds one chunk's hashes of one range: number of entries, the text of
# each (its place in the chunk), how many hashes it has, names of the texts (8 bytes,
# only on the way out), and the hashes in text order.  Only texts with a hash have
# entries, one for each 65,535 hashes.

CHUNK_TEXTS = 1 << 16
MOST = (1 << 16) - 1


def put_range(counts: np.ndarray, values: np.ndarray, names: np.ndarray | None = None) -> bytes:
    """``counts`` has the number of hashes of the chunk's texts, by place."""
    there = np.flatnonzero(counts)
    times = -(-counts[there] // MOST)
    texts = np.repeat(there, times)
    each = np.full(len(texts), MOST, dtype="<u2")
    if len(there):
        each[np.cumsum(times) - 1] = counts[there] - (times - 1) * MOST
    named = b"" if names is None else names[texts].tobytes()
    return struct.pack("<I", len(texts)) + texts.astype("<u2").tobytes() + each.tobytes() + named + values.tobytes()


def get_range(payload: bytes, kind: str = "<u8", named: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text of each hash, name of each hash's text (empty if not sent), hashes."""
    n = struct.unpack_from("<I", payload)[0]
    texts = np.frombuffer(payload, "<u2", n, 4).astype(np.int64)
    counts = np.frombuffer(payload, "<u2", n, 4 + 2 * n).astype(np.int64)
    names = np.frombuffer(payload, "<u8", n if named else 0, 4 + 4 * n)
    values = np.frombuffer(payload, kind, offset=4 + (12 if named else 4) * n)
    return np.repeat(texts, counts), np.repeat(names, counts) if named else names, values


def range_payloads(docs: DataFrame, size: int, ranges: int) -> DataFrame:
    """(range, lane, chunk, classes, payload): each chunk of texts, cut by hash range.

    One more row per chunk has its class names and how many hashes each has; its
    lane is the chunk, so these rows do not meet.  Copies inside a chunk count once.
    """

    def cut(chunk: int, sets: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        classes = list(sets)
        names = np.array([int.from_bytes(c[:8], "little") for c in classes], dtype="<u8")
        values = np.concatenate(list(sets.values()))
        text = np.repeat(np.arange(len(classes)), [len(s) for s in sets.values()])
        where = (values >> np.uint64(40)).astype(np.int64) * ranges >> 24
        order = np.argsort(where, kind="stable")  # texts stay in order inside a range
        values, text, where = values[order], text[order], where[order]
        edges = np.searchsorted(where, np.arange(ranges + 1))
        there = np.flatnonzero(np.diff(edges)).tolist()
        payloads = [
            put_range(np.bincount(text[a:b]), values[a:b], names)
            for a, b in zip(edges[there].tolist(), edges[np.array(there) + 1].tolist())
        ]
        totals = np.array([len(s) for s in sets.values()], dtype="<u4").tobytes()
        n = len(there)
        return pa.RecordBatch.from_arrays(
            [pa.array([-1, *there], pa.int32()), pa.array([chunk] + [-1] * n, pa.int64()),
             pa.array([chunk] * (n + 1), pa.int64()),
             pa.array([b"".join(classes)] + [None] * n, pa.binary()),
             pa.array([totals, *payloads], pa.binary())],
            ["range", "lane", "chunk", "classes", "payload"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        sets: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            for text in batch.column(1):
                words = words_of(text.as_py())
                if not words or (name := class_of(words)) in sets:
                    continue
                sets[name] = set_of(words, size)
                held += 8 * len(sets[name]) + 16
                if held >= CHUNK_BYTES or len(sets) == CHUNK_TEXTS:
                    yield cut(chunk, sets)
                    chunk, sets, held = chunk + 1, {}, 0
        if sets:
            yield cut(chunk, sets)

    return docs.mapInArrow(work, "range int, lane bigint, chunk bigint, classes binary, payload binary")


def shared_shingles(payloads: DataFrame) -> DataFrame:
    """(chunk, classes, payload): per range and chunk what is held by several
    texts, as (hash, holders) pairs; rows with class names stay as they are."""

    def work(table: pa.Table) -> pa.Table:
        if table.column("range")[0].as_py() < 0:
            return table.select(["chunk", "classes", "payload"])
        parts = [get_range(p, named=True) for p in table.column("payload").to_pylist()]
        values = np.concatenate([p[2] for p in parts])
        owner = np.concatenate([p[1] for p in parts])
        order = np.argsort(values, kind="stable")
        ranked, by = values[order], owner[order]
        holders = np.zeros(len(values), dtype="<u4")
        if len(ranked):
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            several = np.minimum.reduceat(by, first) != np.maximum.reduceat(by, first)
            width = np.diff(np.append(first, len(ranked)))
            holders[order] = np.repeat(np.where(several, width, 0), width)
        chunks, out, at = [], [], 0
        for chunk, (text, _, own) in zip(table.column("chunk").to_pylist(), parts):
            mine = holders[at:at + len(own)]
            at += len(own)
            keep = mine > 0
            if not keep.any():
                continue
            pairs = np.empty(int(keep.sum()), dtype=PAIR)
            pairs["hash"], pairs["holders"] = own[keep], mine[keep]
            chunks.append(chunk)
            out.append(put_range(np.bincount(text[keep]), pairs))
        return pa.table({"chunk": pa.array(chunks, pa.int64()),
                         "classes": pa.nulls(len(out), pa.binary()), "payload": pa.array(out, pa.binary())})

    return payloads.groupBy("range", "lane").applyInArrow(
        work, "chunk bigint, classes binary, payload binary")


PAIR = np.dtype([("hash", "<u8"), ("holders", "<u4")])


def candidate_texts(shared: DataFrame, percent: int) -> DataFrame:
    """(class, n, shared, first): texts that can have a partner, their shared
    shingles from rare to common, and how many of those must meet a partner's."""

    def work(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("classes").to_pylist(), table.column("payload").to_pylist()))
        classes, totals = next(r for r in rows if r[0] is not None)
        total = np.frombuffer(totals, "<u4").astype(np.int64)
        parts = [get_range(p, PAIR) for c, p in rows if c is None]
        pairs = np.concatenate([np.empty(0, dtype=PAIR), *(p[2] for p in parts)])
        text = np.concatenate([np.empty(0, dtype=np.int64), *(p[0] for p in parts)])
        order = np.lexsort((pairs["hash"], pairs["holders"], text))
        pairs, text = pairs[order], text[order]
        edges = np.searchsorted(text, np.arange(len(total) + 1))
        held = np.diff(edges)
        # Shingles of no other text come first in the order and meet nobody.
        first = total - needed(total, percent) + 1 - (total - held)
        rows = [
            (classes[16 * i:16 * i + 16], int(total[i]),
             pairs["hash"][edges[i]:edges[i + 1]].tobytes(), int(first[i]))
            for i in np.flatnonzero((first > 0) & (held > 0)).tolist()
        ]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table({
            "class": pa.array(columns[0], pa.binary()), "n": pa.array(columns[1], pa.int64()),
            "shared": pa.array(columns[2], pa.binary()), "first": pa.array(columns[3], pa.int64())})

    found = shared.groupBy("chunk").applyInArrow(
        work, "class binary, n bigint, shared binary, first bigint")
    return found.dropDuplicates(["class"])


def inverted_lists(texts: DataFrame) -> DataFrame:
    """(list, class, n, held, rest, size): rare shingles with several texts; of
    lists that hold the same texts the rarest is kept.  ``held`` counts a text's
    shared shingles, ``rest`` those from this one on, in the order of all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, held, rest, hashes = [], [], [], [], []
            for name, n, shared, first in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.frombuffer(shared, "<i8")[:first].tolist()
                classes += [name] * len(found)
                sizes += [n] * len(found)
                held += [len(shared) // 8] * len(found)
                rest += range(len(shared) // 8, len(shared) // 8 - len(found), -1)
                hashes += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(classes, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(held, pa.int64()), pa.array(rest, pa.int64())],
                ["list", "class", "n", "held", "rest"])

    entries = stored(
        texts.select("class", "n", "shared", "first").mapInArrow(
            work, "list bigint, class binary, n bigint, held bigint, rest bigint"), "jaccard-lists")
    members = entries.groupBy("list").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("class")).alias("x"),
        F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"),
        F.max("rest").alias("top")).where("size > 1")
    # A rarer shingle has more after it, in each of the texts.
    kept = members.groupBy("size", "x", "y").agg(F.max_by("list", "top").alias("list")).select("list", "size")
    return entries.join(kept, "list")


def divide_skip(query: np.ndarray, index: tuple[np.ndarray, np.ndarray], texts: int, least: np.ndarray,
                long_list: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a block that share at least ``least`` (per text) of the query's
    shingles, and how many.

    ``index`` is the block's (shingle, text) pairs in order.  Lists of up to
    ``long_list`` texts are merged by counting; a text that cannot reach its
    number even if it were in all long lists is out, and the others are probed
    in the long lists by binary search.
    """
    keys, owners = index
    low, high = np.searchsorted(keys, query, "left"), np.searchsorted(keys, query, "right")
    width = high - low
    short, long = (width > 0) & (width <= long_list), np.flatnonzero(width > long_list)
    taken = np.concatenate([owners[a:b] for a, b in zip(low[short], high[short])] or [owners[:0]])
    counts = np.bincount(taken, minlength=texts)
    alive = np.flatnonzero((counts + len(long) >= least) & (counts + len(long) > 0))
    for done, i in enumerate(long.tolist(), 1):
        if not len(alive):
            break
        members = owners[low[i]:high[i]]
        at = np.minimum(np.searchsorted(members, alive), len(members) - 1)
        counts[alive] += members[at] == alive
        alive = alive[counts[alive] + len(long) - done >= least[alive]]
    alive = alive[counts[alive] >= np.maximum(least[alive], 1)]
    return alive, counts[alive]


def search(questions: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the texts that ask and the texts of their block.

    ``questions`` has list, part, class, label, n, shared, asks; the rows of one
    part come together.  A link is given when it joins two components (by label
    or by links before it), so a part gives fewer links than it has texts.
    """

    def work(table: pa.Table) -> pa.Table:
        rows = table.select(["class", "label", "n", "shared", "asks"]).to_pylist()
        rows.sort(key=lambda r: (r["class"], not r["asks"]))
        rows = [r for i, r in enumerate(rows) if not i or rows[i - 1]["class"] != r["class"]]
        sets = [np.frombuffer(r["shared"], "<u8") for r in rows]
        keys = np.concatenate(sets)
        owners = np.repeat(np.arange(len(rows)), [len(s) for s in sets])
        order = np.lexsort((owners, keys))
        index, sizes = (keys[order], owners[order]), np.array([r["n"] for r in rows])
        links, parent = [], {r["label"]: r["label"] for r in rows}

        def find(label: bytes) -> bytes:
            while parent[label] != label:
                parent[label] = label = parent[parent[label]]
            return label

        for i, row in enumerate(rows):
            if not row["asks"]:
                continue
            # 100 * shared >= percent * (n + m - shared)
            least = -(-percent * (sizes + row["n"]) // (100 + percent))
            found, _ = divide_skip(sets[i], index, len(rows), least, max(8, len(rows) // 8))
            for j in found.tolist():
                mine, other = find(row["label"]), find(rows[j]["label"])
                if mine != other:
                    parent[mine] = other
                    links.append((row["class"], rows[j]["class"]))
        columns = list(zip(*links)) or [[]] * 2
        return pa.table({"a": pa.array(columns[0], pa.binary()), "b": pa.array(columns[1], pa.binary())})

    return questions.groupBy("list", "part").applyInArrow(work, "a binary, b binary")


def possible(percent: int, a: str, b: str) -> Column:
    """Whether sizes and shared shingles of two entries allow a link."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    least = F.ceil(F.lit(percent) * n / F.lit(100 + percent))
    return (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent) & (
        F.least(f"{a}.held", f"{b}.held") >= least)


def spare(percent: int) -> Column:
    """percent times the largest partner that an entry can link with, if they
    share nothing before the entry's list."""
    return F.col("rest") * (100 + percent) - F.col("n") * percent


def first_met(percent: int, a: str, b: str) -> Column:
    """Whether two entries of a list can link, given that it is the first they share."""
    return (F.col(f"{a}.spare") >= F.col(f"{b}.n") * percent) & (
        F.col(f"{b}.spare") >= F.col(f"{a}.n") * percent)


def blocks_of(pairs: DataFrame) -> DataFrame:
    """Entries (list, class, label, asks) of pairs (asker, asker_label, other,
    other_label): a block for each asker."""
    found = pairs.distinct()
    return found.select(
        F.col("asker").alias("list"), F.col("other").alias("class"),
        F.col("other_label").alias("label"), F.lit(False).alias("asks")
    ).unionByName(found.select(
        F.col("asker").alias("list"), F.col("asker").alias("class"),
        F.col("asker_label").alias("label"), F.lit(True).alias("asks")
    ).distinct())


def ask(entries: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links found in blocks of entries (list, class, label, asks).

    A block of many bytes is cut by hash into parts, and its questions go to all
    of them: for blocks with one or few texts that ask.
    """
    marked = entries.join(texts.select("class", "n", "shared"), "class")
    volume = entries.join(texts.select("class", F.octet_length("shared").alias("bytes")), "class")
    parts = volume.groupBy("list").agg(F.sum("bytes").alias("bytes")).select(
        "list", (F.col("bytes") / BLOCK_BYTES).cast("int").alias("last"))
    placed = marked.join(parts, "list")
    own = F.pmod(F.xxhash64("class"), F.col("last") + 1).cast("int")
    spread = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("last"))).otherwise(F.array(own))
    return search(placed.withColumn("part", F.explode(spread)).select(
        "list", "part", "class", "label", "n", "shared", "asks"), percent)


def ask_lists(entries: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links found in whole lists (list, class, label, n, held, spare, outside),
    where the texts outside ask.

    Texts are in bands of sizes, and who asks goes to the bands where its size and
    place allow a partner.  In a band both sides are cut by hash into parts of
    half of ``BLOCK_BYTES``, and each part that asks meets each part of texts.
    """
    width = math.log(max(100 / percent, 1.05))

    def band(n: Column) -> Column:
        return F.floor(F.log(n) / width).cast("int")

    def cut(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("list", "band").agg(
            (F.sum(F.col("held") * 8) / (BLOCK_BYTES / 2)).cast("int").alias(name))

    n = F.col("n")
    low = F.ceil(n * percent / 100)
    high = F.least(F.floor(n * 100 / percent), F.floor(F.col("spare") / percent))
    holders = entries.withColumn("band", band(n))
    askers = entries.where("outside").withColumn("band", F.explode(F.sequence(band(low), band(high))))
    grid = cut(holders, "last_text").join(cut(askers, "last_asker"), ["list", "band"])

    def placed(rows: DataFrame, asks: bool, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("class"), F.col(own) + 1).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col(other)), lambda i: F.struct(
            F.col("band"), (part if asks else i).alias("asker"), (i if asks else part).alias("text")))
        return rows.join(grid, ["list", "band"]).select(
            "list", "class", "label", F.lit(asks).alias("asks"), cells.alias("parts"))

    both = placed(holders, False, "last_text", "last_asker").unionByName(
        placed(askers, True, "last_asker", "last_text"))
    return search(both.join(texts.select("class", "n", "shared"), "class").withColumn(
        "part", F.explode("parts")).select(
            "list", "part", "class", "label", "n", "shared", "asks"), percent)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links).

    A text of fewer than ``size`` words is one shingle, its whole sequence; null
    texts and texts without words have no shingles and link with nothing.  Rows
    with a null id take part in links; a component without any id has a null
    component.  Repeated rows stay rows, several texts under one id each link,
    ties do not matter (components are the same in any order), an empty table
    gives no rows, and only id and text are read.  Shingles are compared by
    64-bit hashes.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("row_id"), whole_text(text_column).alias("text"))
    named = stored(class_rows(rows, size), "jaccard-rows")
    ranges = max(1, min(1 << 20, input_bytes(rows, "text") // RANGE_BYTES))
    # What is written grows with the texts and not with the session's partitions:
    # on a local file system each file starts processes that set its permissions.
    files = max(LEAST_FILES, ranges)
    texts = stored(
        candidate_texts(shared_shingles(range_payloads(rows, size, ranges)), percent),
        "jaccard-texts", files)
    release(docs.sparkSession)
    entries = stored(inverted_lists(texts), "jaccard-entries", files)
    # The smallest set of each list asks first.
    least = entries.groupBy("list").agg(F.min(F.struct("n", "class", "held")).alias("one"))
    led = entries.alias("e").join(least, "list").where(
        (F.col("e.class") != F.col("one.class")) & possible(percent, "e", "one"))
    links = stored(ask(blocks_of(led.select(
        F.col("one.class").alias("asker"), F.col("one.class").alias("asker_label"),
        F.col("e.class").alias("other"), F.col("e.class").alias("other_label"))), texts, percent).distinct(),
        "jaccard-links", files)
    release(docs.sparkSession)
    labels = stored(components(links, files), "jaccard-labels", files)
    # Lists that hold several components: all texts outside the largest one ask.
    labelled = entries.join(
        labels.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "label", F.coalesce("label", "class")).withColumn("spare", spare(percent))
    held = labelled.groupBy("list", "label").agg(
        F.count("*").alias("members"), F.min("n").alias("least"), F.max("spare").alias("most"))
    largest = held.groupBy("list").agg(
        F.count("*").alias("labels"), F.max(F.struct("members", "label")).alias("top"),
        F.min("least").alias("least"), F.max("most").alias("most")).where("labels > 1")
    # Only entries that size and place allow to link with any of their list.
    smallest = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    opened = stored(labelled.join(largest, "list").where(
        (F.col("most") >= F.col("n") * percent) & (F.col("spare") >= smallest * percent)).withColumn(
            "outside", F.col("label") != F.col("top.label")).drop("top", "labels", "least", "most"),
        "jaccard-open", files)
    # Short lists in pairs, as most pairs stand in many of them; long ones in bands.
    short = opened.where(F.col("size") <= SMALL_LIST)
    pairs = short.where("outside").alias("a").join(short.alias("b"), "list").where(
        (F.col("a.label") != F.col("b.label")) & (~F.col("b.outside") | (F.col("a.class") < F.col("b.class")))
        & possible(percent, "a", "b") & first_met(percent, "a", "b"))
    long = opened.where(F.col("size") > SMALL_LIST)
    more = ask(blocks_of(pairs.select(
        F.col("a.class").alias("asker"), F.col("a.label").alias("asker_label"),
        F.col("b.class").alias("other"), F.col("b.label").alias("other_label"))), texts, percent
    ).unionByName(ask_lists(long, texts, percent))
    links = links.unionByName(stored(more.distinct(), "jaccard-links", files))
    del more, pairs, short, long, led
    release(docs.sparkSession)
    labels = components(links, files)
    # Components of rows: smallest id of a class, then of its label's classes.
    classes = named.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("row_id").alias("least"))
    joined = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "label", F.coalesce("label", "class"))
    smallest = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    found = stored(joined.join(smallest, "label").select("class", "component_id"), "jaccard-components", files)
    return named.join(found, "class", "left").select(
        F.col("row_id").alias(id_column), "n_shingles",
        F.when(F.col("class").isNull(), F.col("row_id")).otherwise(
            F.col("component_id")).alias("component_id")).coalesce(files)


def keep_first(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component, with all columns: that of its smallest id.

    Rows with a null id are kept.  Rows that repeat an id and a text are one.
    Null and empty texts are components of their own, texts may be of any length,
    columns may have any names and hold nulls, and an empty table gives no rows.
    """
    found = near_duplicates(docs, size, percent)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("component_id").distinct()
    named = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"),
                        F.xxhash64("text").alias("text_hash"))
    kept = named.join(first, F.col("id") == F.col("component_id"), "left_semi")
    once = Window.partitionBy("id", "text_hash").orderBy("text_hash")
    return kept.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row").unionByName(
        named.where(F.col("id").isNull()).select("row")).select(*row_columns(docs, "row"))
