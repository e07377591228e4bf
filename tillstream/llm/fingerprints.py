"""Document fingerprints by consistent weighted sampling.

For each of K samples every term has fixed random numbers r, c (gamma) and beta
(uniform); a term of weight w has the position t = floor(ln w / r + beta) and
the value ln a = ln c - r (t - beta) - r.  The sample is the (term, t) of the
smallest value, and two texts share a sample with a probability equal to the
generalised Jaccard similarity of their weighted terms.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.llm.common import input_bytes, whole_text
from tillstream.llm.hashing import mix, shingles

SAMPLES = 64
TERMS_PER_BLOCK = 256
# Terms whose values are held at once.
TERMS_HELD = 1 << 14
# Texts whose terms are worked out together have about so many.
TERMS_PER_GROUP = 1 << 15


def uniform(bits: np.ndarray) -> np.ndarray:
    """The low 23 bits as numbers strictly between 0 and 1; ``bits`` is used up."""
    bits &= np.uint32(0x7FFFFF)
    bits |= np.uint32(0x3F800000)
    ones = bits.view(np.float32)
    ones -= np.float32(1 - 2.0 ** -24)
    return ones


def mixed(h: np.ndarray, spare: np.ndarray) -> None:
    """``hashing.mix`` in place."""
    for last in (False, False, True):
        np.right_shift(h, np.uint64(32), out=spare)
        h ^= spare
        if not last:
            h *= np.uint64(0xD6E8FEB86659FD93)


def halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The high and the low 32 bits, as views."""
    both = h.view(np.uint32).reshape(*h.shape, 2)
    low = 0 if sys.byteorder == "little" else 1
    return both[..., 1 - low], both[..., low]


def product(h: np.ndarray, spare: np.ndarray, out: np.ndarray) -> None:
    """The product of two uniform numbers, of each half's top 23 bits."""
    bits = np.right_shift(h.view(np.uint32), np.uint32(9), out=spare.view(np.uint32))
    ones = uniform(bits).reshape(*h.shape, 2)
    np.multiply(ones[..., 0], ones[..., 1], out=out)


class Sampler:
    """Fingerprints of texts.  Terms are runs of two words, weighted by how often
    they occur and told apart by their 64-bit hash; the random numbers of a term
    and sample are mixed from that hash and the sample's keys."""

    def __init__(self, samples: int = SAMPLES, seed: int = 11):
        random = np.random.Generator(np.random.PCG64(seed))
        self.samples = samples
        self.keys = random.integers(0, 1 << 64, (2, 1, samples), dtype=np.uint64)
        self.room = [np.empty((TERMS_PER_BLOCK, samples), dtype=k) for k in (
            np.uint64, np.uint64, np.uint64, np.float32, np.uint32, np.uint32)]

    def numbers(self, terms: np.ndarray, ln_c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """r and beta of at most a block of terms, a row for each, and ln c in its
        place; r and beta hold until the next call."""
        a, b, spare, r, beta, bits = (x[:len(terms)] for x in self.room)
        np.bitwise_xor(terms[:, None], self.keys[0], out=a)
        mixed(a, spare)
        np.add(a, self.keys[1], out=b)
        mixed(b, spare)
        a_high, a_low = halves(a)
        np.bitwise_and(a_low, np.uint32(511), out=beta)
        beta <<= np.uint32(5)
        beta ^= np.left_shift(a_high, np.uint32(14), out=bits)
        beta ^= np.bitwise_and(halves(b)[0], np.uint32(31), out=bits)
        # The sum of two exponential numbers is gamma(2).
        product(a, spare, r)
        np.log(r, out=r)
        np.negative(r, out=r)
        product(b, spare, ln_c)
        np.log(ln_c, out=ln_c)
        np.negative(ln_c, out=ln_c)
        np.log(ln_c, out=ln_c)
        return r, uniform(beta)

    def values(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The value of each weighted term (row) and sample (column); the rows with
        a weight other than 1, and their positions.  Weight 1, by far the most
        common, has position 0."""
        value = np.empty((len(terms), self.samples), dtype=np.float32)
        heavy = np.flatnonzero(weights != 1)
        ln_w = np.log(weights[heavy]).astype(np.float32)[:, None]
        t = np.empty((len(heavy), self.samples), dtype=np.float32)
        for at in range(0, len(terms), TERMS_PER_BLOCK):
            ln_c = value[at:at + TERMS_PER_BLOCK]
            r, beta = self.numbers(terms[at:at + TERMS_PER_BLOCK], ln_c)
            a, b = np.searchsorted(heavy, [at, at + TERMS_PER_BLOCK])
            if a < b:
                some = heavy[a:b] - at
                t[a:b] = np.floor(ln_w[a:b] / r[some] + beta[some])
                others = ln_c[some] - r[some] * (t[a:b] - beta[some]) - r[some]
            beta *= r
            ln_c += beta
            ln_c -= r
            if a < b:
                ln_c[some] = others
        return value, heavy, t

    def of(self, text: str) -> np.ndarray:
        """Samples as 32-bit numbers; all zero for a text without words."""
        return self.of_each([weigh(text)])[0]

    def of_each(self, texts: "list[Terms]") -> list[np.ndarray]:
        """The samples of several texts; a weighted term that some of them share
        is worked out once."""
        if not texts:
            return []
        terms, weights = (np.concatenate(x) for x in zip(*texts))
        order = np.argsort(terms, kind="stable")
        terms, weights = terms[order], weights[order]
        new = np.ones(len(terms), dtype=bool)
        new[1:] = (terms[1:] != terms[:-1]) | (weights[1:] != weights[:-1])
        places = np.empty(len(terms), dtype=np.int64)
        places[order] = np.cumsum(new) - 1
        terms, weights = terms[new], weights[new]
        # A text's terms ascend, and so do their places.
        of_text = np.split(places, np.cumsum([len(t) for t, _ in texts])[:-1])
        least = [Least(self.samples) for _ in texts]
        for at in range(0, len(terms), TERMS_HELD):
            part = terms[at:at + TERMS_HELD]
            value, heavy, t = self.values(part, weights[at:at + TERMS_HELD])
            place = np.full(len(part), -1)
            place[heavy] = np.arange(len(heavy))
            for one, own in zip(least, of_text):
                a, b = np.searchsorted(own, [at, at + TERMS_HELD])
                if a == b:
                    continue
                own = own[a:b] - at
                found = value.take(own, axis=0, mode="clip")
                low = found.min(axis=0)
                i, sample = np.divmod(np.flatnonzero(found == low), self.samples)
                first = np.empty(self.samples, dtype=np.int64)
                first[sample[::-1]] = own[i[::-1]]  # of equal values the smallest term, as terms are in order
                position, of_heavy = np.zeros(self.samples, dtype=np.int64), place[first]
                some = np.flatnonzero(of_heavy >= 0)
                if len(some):
                    position[some] = t[of_heavy[some], some].astype(np.int64)
                one.take(low, part[first], position)
        return [one.names() for one in least]


Terms = tuple[np.ndarray, np.ndarray]  # hashes in ascending order, and weights


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def weigh(text: str) -> Terms:
    """The terms of a text with their weights."""
    return counted(shingles(words_of(text), 2))


def counted(runs: np.ndarray) -> Terms:
    """Terms with weights, from the hashes of all runs of a text."""
    terms = np.sort(runs)
    first = np.ones(len(terms), dtype=bool)
    first[1:] = terms[1:] != terms[:-1]
    first = np.flatnonzero(first)
    return terms[first], np.diff(first, append=len(terms))


class Least:
    """The smallest value of each sample, and the term and position that have it;
    of equal values the smallest term, so the order of additions does not matter."""

    def __init__(self, samples: int) -> None:
        self.low = np.full(samples, np.inf, dtype=np.float32)
        self.term = np.zeros(samples, dtype=np.uint64)
        self.position = np.zeros(samples, dtype=np.int64)

    def take(self, low: np.ndarray, term: np.ndarray, position: np.ndarray | int) -> None:
        better = (low < self.low) | (low == self.low) & (term < self.term)
        self.low = np.where(better, low, self.low)
        self.term = np.where(better, term, self.term)
        self.position = np.where(better, position, self.position)

    def names(self) -> np.ndarray:
        if np.isinf(self.low).all():
            return np.zeros(len(self.low), dtype=np.uint32)
        name = mix(self.term * np.uint64(0x100000001B3) + self.position.astype(np.uint64))
        return name.astype(np.uint32)


_SAMPLERS: dict[int, Sampler] = {}


def sampler(samples: int) -> Sampler:
    if samples not in _SAMPLERS:
        _SAMPLERS[samples] = Sampler(samples)
    return _SAMPLERS[samples]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the beginning of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


class Row:
    """A row of a slice; ``extra`` rows are the end of theirs and give no result."""

    def __init__(self, row_id: int | None, text: str, part: int, extra: bool):
        self.row_id, self.text, self.part, self.extra = row_id, text, part, extra
        self.words = words_of(text)
        self.runs = shingles(self.words, 2)
        self.terms = counted(self.runs)
        self.changed: Terms | None = None  # of the edited text, once the next row is there
        self.digest = ""
        self.mine: np.ndarray | None = None

    def edit(self, following: str) -> None:
        """Digest and terms of the edited text; runs of words that end before the
        edit are not hashed again."""
        changed = edited(self.text, following)
        self.digest = hashlib.sha256(changed.encode()).hexdigest()
        cut = len(self.text) - len(self.text) // 4
        gap = max(self.text.rfind(c, 0, cut) for c in " \t\n\v\f\r")
        tail, kept = [], 0
        if gap >= 0:
            tail = words_of(changed[gap:])
            kept = len(self.words) - len(words_of(self.text[gap:]))
        if tail and kept > 1:
            self.changed = counted(np.concatenate(
                [self.runs[:kept - 1], shingles([self.words[kept - 1], *tail], 2)]))
        else:
            self.changed = weigh(changed)


class Group:
    """Neighbouring rows whose fingerprints are worked out together: an edited text
    has its terms from its own text and from the next."""

    def __init__(self, sample: Sampler):
        self.sample = sample
        self.rows: list[Row] = []
        self.size = 0

    def add(self, row_id: int | None, text: str, part: int, extra: bool) -> None:
        row = Row(row_id, text, part, extra)
        self.size += len(row.terms[0])
        if self.rows and not self.rows[-1].extra and self.rows[-1].part == part:
            before = self.rows[-1]
            before.edit(text)
            self.size += len(before.changed[0])
        self.rows.append(row)

    def closed(self) -> pa.RecordBatch:
        """Results of all rows whose next is there; the last row waits for its own."""
        alone = [r for r in self.rows if r.mine is None]
        both = [r for r in self.rows if r.changed is not None]
        found = iter(self.sample.of_each([r.terms for r in alone] + [r.changed for r in both]))
        for row in alone:
            row.mine = next(found)
        out = []
        for row, following in zip(self.rows, self.rows[1:]):
            if row.changed is not None:
                other = next(found)
                out.append((row.row_id, len(row.text), row.digest, row.mine.tobytes().hex(),
                            other.tobytes().hex(), likeness(row.mine, other),
                            likeness(row.mine, following.mine)))
        self.rows, self.size = self.rows[-1:], 0
        columns = list(zip(*out)) or [[]] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], NAMES)


def with_next(docs: DataFrame, slice_bytes: int) -> DataFrame:
    """Rows (row_id, text, slice, extra) in slices of the id order.

    Slices are ranges of ids with about ``slice_bytes`` of text each.  The first
    row of each slice is given to the slice before it as an extra row (and the
    very first to the last), so each slice knows all its successors.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("row_id"), whole_text().alias("text"))
    n = min(10_000, max(1, input_bytes(rows, "text") // slice_bytes))
    found = rows.agg(F.percentile_approx(
        "row_id", F.array(*(F.lit(i / n) for i in range(1, n + 1))), 10 * n).alias("q")).first()["q"]
    bounds = sorted(set(found or []))[:-1]  # at most 10,000 numbers
    # The slice of an id is the number of bounds below it; null ids are in the first.
    placed = rows.withColumn("slice", slice_of(F.col("row_id"), bounds))
    firsts = placed.groupBy("slice").agg(
        F.count(F.when(F.col("row_id").isNull(), 1)).alias("nulls"),
        F.min("row_id").alias("first")).collect()
    heads = {r["slice"]: None if r["nulls"] else r["first"] for r in firsts}
    order = sorted(heads)
    back = [(heads[s], order[i - 1] if i else order[-1]) for i, s in enumerate(order)]
    if not back:
        return placed.withColumn("extra", F.lit(False))
    halo = spark.createDataFrame(back, "head bigint, slice int")
    extra = (
        rows.join(F.broadcast(halo), F.col("row_id").eqNullSafe(F.col("head")))
        .groupBy("row_id", "slice").agg(F.min("text").alias("text"))
        .select("row_id", "text", "slice", F.lit(True).alias("extra"))
    )
    both = placed.withColumn("extra", F.lit(False)).unionByName(extra)
    # Slice i to partition i: a hash would give several slices to some tasks and none to others.
    return both.repartitionById(n + 1, "slice").sortWithinPartitions(
        "slice", "extra", F.col("row_id").asc_nulls_first(), "text")


def slice_of(row_id: Column, bounds: list[int]) -> Column:
    """Binary search over the bounds, as nested conditions."""
    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(row_id <= F.lit(bounds[middle]), pick(low, middle)).otherwise(
            pick(middle + 1, high))

    return F.coalesce(F.when(row_id.isNull(), F.lit(0)).otherwise(pick(0, len(bounds))), F.lit(0))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES,
                          slice_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next for every row.

    The next document is the one after in ascending (doc_id, text), null ids
    first, and for the last row the first; a single row is its own next.  Null
    texts count as empty.  Texts without words have a fingerprint of zeros,
    which is like itself only.  Equal texts have equal fingerprints; repeated
    rows stay rows; an empty table gives no rows; only doc_id and text are read,
    whatever other columns there are.  Each text moves once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group(sampler(samples))
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                group.add(*row)
                if group.size >= TERMS_PER_GROUP:
                    yield group.closed()
        yield group.closed()

    rows = with_next(docs, slice_bytes).select("row_id", "text", "slice", "extra")
    return rows.mapInArrow(work, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
         "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")
