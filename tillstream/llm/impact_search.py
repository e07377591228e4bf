"""Exact top-k inner products from an impact-ordered index.

A component of a vector is a posting: its vector, its dimension and its impact,
an integer.  The index holds chunks of vectors; the postings of a chunk lie in
segments of descending quantised impact (powers of two of the absolute value),
each with what every vector has left after it: the length of the vector of its
smaller components and their largest value.

A query reads a chunk segment by segment and adds products to accumulators, one
per vector.  What is left can add at most the product of the two remaining
lengths (Cauchy-Schwarz), and at most the query's absolute sum times the largest
impact left.  Reading stops only on that proof: when the vectors that could
still reach the k-th score found so far are few, exactly these are scored from
all their components, and with none the chunk is done.

Queries and chunks meet in a grid of cells: each query block against each chunk
group, both of bounded size.  A cell gives at most k vectors a query, and the
best k of all cells are the answer.  Cells begin with the k-th score that a query
has in a few seed chunks, below which no vector can be among its best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tillstream.llm.common import stored

CHUNK_ROWS = 2048
CELLS = 64  # least number of cells, so that a small table is searched by many tasks
CELL_PAIRS = 1 << 36  # pairs of query and vector in one cell
QUERY_ROWS = 256  # queries that read a chunk together
FEW = 1 / 32  # share of vectors that may be left when reading stops
SEEDS = 4  # chunks that give the first bound of each query's k-th score
LIMIT = float(1 << 62)
_DTYPES = (np.int8, np.int16, np.int32, np.int64)

INDEX = ("chunk bigint, n int, width int, dtype int, ids binary, known binary, rows binary, "
         "dims binary, impacts binary, ends binary")
FOUND = "query bigint, query_row bigint, ids array<bigint>, scores array<bigint>"


def whole_impacts(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null unless all are finite numbers."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    wide = F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))).cast("bigint"))
    return F.when(usable, wide)


def _chunk(number: int, ids: list, rows: list[list[int]]) -> tuple:
    """One index row of some vectors; vectors of unequal length end in zeros."""
    n, width = len(rows), max(map(len, rows), default=0)
    matrix = np.zeros((n, width), dtype=np.int64)
    for i, row in enumerate(rows):
        matrix[i, :len(row)] = row
    size = int(np.abs(matrix).max(initial=0))
    dtype = next(i for i, t in enumerate(_DTYPES) if size <= np.iinfo(t).max)
    at, dim = np.nonzero(matrix)
    impact = matrix[at, dim]
    level = np.frexp(np.abs(impact).astype(np.float64))[1]  # 1 for 1, 2 for 2 and 3, ...
    order = np.lexsort((at, dim, -level))
    ends = np.flatnonzero(np.diff(level[order], append=-1)) + 1
    known = np.array([i is not None for i in ids], dtype=np.uint8)
    named = np.array([i or 0 for i in ids], dtype=np.int64)
    return (number, n, width, dtype, named.tobytes(), known.tobytes(),
            at[order].astype(np.uint16).tobytes(), dim[order].astype(np.uint32).tobytes(),
            impact[order].astype(_DTYPES[dtype]).tobytes(), ends.astype(np.int64).tobytes())


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("width", pa.int32()),
                        ("dtype", pa.int32()), *[(c, pa.binary()) for c in (
                            "ids", "known", "rows", "dims", "impacts", "ends")]])
    number = TaskContext.get().partitionId() << 32
    ids, rows = [], []

    def flush() -> pa.RecordBatch:
        made = _chunk(number, ids, rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([v], type=f.type) for v, f in zip(made, schema)], schema=schema)

    for batch in batches:
        for key, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(key)
            rows.append(row)
            if len(rows) == CHUNK_ROWS:
                yield flush()
                number, ids, rows = number + 1, [], []
    if rows:
        yield flush()


def build_index(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """The stored index of every vector that takes part: one row per chunk."""
    return stored(
        vectors.select(F.col(key).cast("bigint").alias("key"),
                       whole_impacts(F.col(vector), scale).alias("impacts"))
        .where(F.col("impacts").isNotNull()).mapInArrow(_build, INDEX), "impact-index")


class Chunk:
    """A chunk in memory: its vectors, and the segments as planes that add up to them."""

    def __init__(self, row: dict, width: int) -> None:
        self.n, self.number = row["n"], row["chunk"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.known = np.frombuffer(row["known"], dtype=np.uint8).astype(bool)
        at = np.frombuffer(row["rows"], dtype=np.uint16)
        dim = np.frombuffer(row["dims"], dtype=np.uint32)
        impact = np.frombuffer(row["impacts"], dtype=_DTYPES[row["dtype"]]).astype(np.int64)
        ends = np.frombuffer(row["ends"], dtype=np.int64)
        self.spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        self.at, self.dim, self.impact = at, dim, impact
        self.width = width
        self.matrix = np.zeros((self.n, width), dtype=np.int64)
        self.matrix[at, dim] = impact
        self.size = int(np.abs(impact).max(initial=0))

    def segments(self, dtype) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Planes by descending impact, each with the lengths left after it and
        the largest impact left."""
        out = []
        for start, end in self.spans:
            plane = np.zeros((self.n, self.width), dtype=dtype)
            plane[self.at[start:end], self.dim[start:end]] = self.impact[start:end]
            rest = self.impact[end:].astype(np.float64)
            squares = np.bincount(self.at[end:], weights=rest * rest, minlength=self.n)
            # A little more than the rounded length, so the bound stays a bound.
            out.append((plane, np.sqrt(squares) * (1 + 1e-9), float(np.abs(rest).max(initial=0))))
        return out


def _exact_type(width: int, a: int, b: int):
    """Smallest type in which sums of products of such integers are exact."""
    most = width * a * b
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def _top(queries: np.ndarray, scores: np.ndarray, keys: np.ndarray, known: np.ndarray,
         k: int) -> np.ndarray:
    """Places of the best k of each query: by score, then known and smaller key."""
    order = np.lexsort((keys, ~known, -scores, queries))
    sorted_q = queries[order]
    first = np.searchsorted(sorted_q, sorted_q, side="left")
    return order[np.arange(len(order)) - first < k]


class Best:
    """The best k of each query so far."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k, self.floor = k, floor  # no score below its floor is among a query's best
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.int64)
        self.key = np.empty(0, dtype=np.int64)
        self.known = np.empty(0, dtype=bool)

    def add(self, query, score, key, known) -> None:
        query = np.concatenate([self.query, query])
        score, key = np.concatenate([self.score, score]), np.concatenate([self.key, key])
        known = np.concatenate([self.known, known])
        keep = _top(query, score, key, known, self.k)
        self.query, self.score, self.key, self.known = (
            query[keep], score[keep], key[keep], known[keep])
        counts = np.bincount(self.query, minlength=len(self.floor))
        last = np.cumsum(counts) - 1
        full = counts >= self.k
        self.floor[full] = np.maximum(self.floor[full], self.score[last[full]])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of paired rows as longs; beyond a long, its nearest end."""
    if a.dtype == object:
        return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1)
                         for s in (a * b).sum(axis=1)], dtype=np.int64)
    return np.einsum("ij,ij->i", a, b).astype(np.int64)


def _members(chunk: Chunk, planes: list, block: np.ndarray, floor: np.ndarray,
             own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of query and vector that can be among the best k, and how many
    segments were read for them."""
    lengths = np.sqrt((block.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    sums = np.abs(block).astype(np.float64).sum(axis=1)
    scores = np.zeros((len(block), chunk.n), dtype=block.dtype)
    left, hits, read = np.arange(len(block)), [], 0
    for plane, rest, largest in planes:
        read += 1
        scores[left] += block[left] @ plane.T
        bound = np.minimum(lengths[left, None] * rest, sums[left, None] * largest)
        possible = scores[left] + bound >= floor[left, None]
        few = possible.sum(axis=1) <= FEW * chunk.n
        if few.any():
            query, vector = np.nonzero(possible[few])
            hits.append((left[few][query], vector))
            left = left[~few]
            if not len(left):
                break
    if len(left):  # every segment is read, so the scores are whole
        whole = scores[left].astype(np.float64)
        mine = own[left]
        whole[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
        least = floor[left]
        if chunk.n > k:
            least = np.maximum(least, np.partition(whole, chunk.n - k, axis=1)[:, chunk.n - k])
        query, vector = np.nonzero(whole >= least[:, None])
        hits.append((left[query], vector))
    return *(np.concatenate(part) for part in zip(*hits)), read


def search_chunk(chunk: Chunk, rows: np.ndarray, own: np.ndarray, best: Best) -> int:
    """Add a chunk's vectors to the best of all queries; the number of segments read.

    ``rows`` are the queries, ``own`` the places of their own vectors here, or -1.
    """
    kind = _exact_type(chunk.width, int(np.abs(rows).max(initial=0)), chunk.size)
    matrix, asked = chunk.matrix.astype(kind), rows.astype(kind)
    # Sums that are not exact prove nothing: such queries score all vectors.
    planes = [] if kind is object else chunk.segments(kind)
    total = 0
    for start in range(0, len(rows), QUERY_ROWS):
        part = slice(start, start + QUERY_ROWS)
        block = asked[part]
        if kind is object:
            query, vector = np.divmod(np.arange(len(block) * chunk.n), chunk.n)
        else:
            query, vector, read = _members(chunk, planes, block, best.floor[part], own[part], best.k)
            total += read
        other = own[part][query] != vector
        query, vector = query[other], vector[other]
        exact = np.empty(len(query), dtype=np.int64)
        for a in range(0, len(query), 1 << 16):
            piece = slice(a, a + (1 << 16))
            exact[piece] = _dot(block[query[piece]], matrix[vector[piece]])
        good = exact >= best.floor[part][query]
        query, vector, exact = query[good], vector[good], exact[good]
        best.add(query + start, exact, chunk.ids[vector], chunk.known[vector])
    return total


def _cell(k: int):
    schema = pa.schema([("query", pa.int64()), ("query_row", pa.int64()),
                        ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])

    def search(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        if not queries.num_rows or not chunks.num_rows:
            return schema.empty_table()
        lists = queries.column("impacts").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        width = max(1, max(chunks.column("width").to_pylist()), int(sizes.max()))
        rows = np.zeros((len(lists), width), dtype=np.int64)
        rows[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
        places = queries.column("query_row").to_numpy()
        homes, offsets = places // CHUNK_ROWS, places % CHUNK_ROWS
        floor = queries.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy()
        best = Best(np.array(floor), k)
        names = [c for c in chunks.column_names if c not in ("group", "slab")]
        for i in range(chunks.num_rows):
            chunk = Chunk({c: chunks.column(c)[i].as_py() for c in names}, width)
            own = np.where(homes == chunk.number, offsets, -1)
            search_chunk(chunk, rows, own, best)
        starts = np.searchsorted(best.query, np.arange(len(rows) + 1))
        keys = pa.array(best.key, mask=~best.known)
        return pa.Table.from_arrays([
            queries.column("query").combine_chunks(), pa.array(places),
            pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), keys),
            pa.ListArray.from_arrays(
                pa.array(starts, type=pa.int32()), pa.array(best.score))], schema=schema)

    return search


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of an index: key, place and impacts."""
    for batch in batches:
        for row in batch.to_pylist():
            chunk = Chunk(row, row["width"])
            yield pa.RecordBatch.from_arrays([
                pa.array(chunk.ids, mask=~chunk.known),
                pa.array(np.arange(chunk.n) + chunk.number * CHUNK_ROWS),
                pa.array(list(chunk.matrix), type=pa.list_(pa.int64()))],
                names=["query", "query_row", "impacts"])


def indexed_vectors(index: DataFrame) -> DataFrame:
    """``query, query_row, impacts`` of every indexed vector."""
    return index.mapInArrow(_vectors, "query bigint, query_row bigint, impacts array<bigint>")


def grid(queries: int, vectors: int) -> tuple[int, int]:
    """Query blocks and chunk groups.

    A cell has at most CELL_PAIRS pairs; of all such grids this moves the fewest
    rows, as both sides are sent once per part of the other.
    """
    cells = max(CELLS, -(-queries * vectors // CELL_PAIRS))
    blocks = max(1, round(math.sqrt(cells * queries / max(1, vectors))))
    return blocks, max(1, -(-cells // blocks))


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best vectors of each query: ``query, query_row, rank, key, score``.

    ``queries`` are rows of ``indexed_vectors`` with ``floor``, a score that the
    k-th best is known to reach, or null; a query's own row is no result.
    """
    n = index.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks, groups = grid(queries.count(), n)
    chunks = index.withColumns({
        "group": F.pmod(F.xxhash64("chunk"), F.lit(groups)),
        "slab": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    slabs = queries.withColumns({
        "slab": F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("int"),
        "group": F.explode(F.sequence(*(F.lit(i).cast("bigint") for i in (0, groups - 1))))})
    cells = chunks.groupBy("slab", "group").cogroup(slabs.groupBy("slab", "group"))
    found = cells.applyInArrow(_cell(k), FOUND).select(
        "query", "query_row",
        F.inline(F.arrays_zip(F.col("ids").alias("key"), F.col("scores").alias("score"))))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query", "query_row", "rank", "key", "score")


def floors(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries with ``floor``, the k-th score that they have in the seed chunks.

    Seeds only begin the search: every chunk is searched for every query after it.
    """
    seeds = [r["chunk"] for r in index.select("chunk").orderBy("chunk").limit(SEEDS).collect()]
    first = search(index.where(F.col("chunk").isin(seeds)),
                   queries.withColumn("floor", F.lit(None).cast("bigint")), k)
    known = first.where(F.col("rank") == k).select("query_row", F.col("score").alias("floor"))
    return queries.join(known, "query_row", "left")


def search_all(
    vectors: DataFrame, key: str, vector: str, asks: Column, k: int, scale: int = 64
) -> DataFrame:
    """The ``k`` highest inner products of ``floor(scale * x)`` for the vectors
    that ask (``asks``, over the column ``query``, the key).

    Returns ``query, query_row, rank, key, score``: at most ``k`` rows a query,
    fewer where there are fewer other vectors; ties go to the smaller key, a null
    key last.  A row is no result of its own; rows that share a key are different
    rows, and each of them that asks is answered (``query_row`` tells them apart).
    Vectors that are null or hold a null or non-finite component take no part.
    Vectors of unequal length are read as if they ended in zeros, an empty one
    scores 0.  Floors beyond 2^62 count as that, scores beyond a long as its ends.
    An empty table gives no rows.  Other columns of ``vectors`` are not read.
    """
    index = build_index(vectors, key, vector, scale)
    queries = stored(indexed_vectors(index).where(asks), "impact-queries")
    return search(index, stored(floors(index, queries, k), "impact-floors"), k)
