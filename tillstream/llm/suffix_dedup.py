"""Removal of byte strings that occur elsewhere, by blockwise suffix sorting.

A suffix matters by its first ``window`` bytes only.  Sorting all suffixes of a
corpus is out of reach, so ties are resolved from a difference cover: positions
i with i mod v in a set D such that any two positions p, q have a k < v with
p + k and q + k both in the cover.

1. The cover sample: the suffixes at cover positions, cut to window - v + 1
   bytes, are sorted bucket by bucket and ranked: tied with another or not.
   With them go anchors: suffixes at places that their own first bytes choose.
2. If the suffixes at p and q tie over the window, so do the cover samples at
   p + k and q + k for some k < v, and all anchors inside the window.  Suffixes
   without a tied cover sample, or with an untied anchor, are out, which leaves
   about the repeated part of the corpus.
3. The suffixes that are left are sorted bucket by bucket over the whole window.

Suffixes travel as 64-bit fingerprints of those bytes, in arrays per chunk of
texts and bucket, and come back as one bit each; a task holds one bucket or one
chunk.  Copies of a text are sorted once and recognised as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.llm.common import input_bytes, release, stored, whole_text
from tillstream.llm.hashing import mix, running, spans
from tillstream.llm.jaccard_join import get, put

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 6 << 20
BLOCK = 1 << 18
ANCHOR_BYTES = 16
ANCHOR_MASK = np.uint64(31)  # one place in 32 is an anchor


def difference_cover(window: int) -> tuple[int, np.ndarray]:
    """Period v and cover D for a window: the perfect difference set of the
    largest prime p with p^2 + p + 1 below about three quarters of the window.

    Powers of a generator of the field with p^3 elements that lie in the plane
    without the square term give the set.  Windows under 10 use v = 1.
    """
    primes = [p for p in range(2, 200) if all(p % d for d in range(2, p))
              and p * p + p + 1 <= 0.77 * window]
    if not primes:
        return 1, np.zeros(1, dtype=np.int64)
    p = primes[-1]
    v, order = p * p + p + 1, p ** 3 - 1
    for a in range(p):
        for b in range(p):
            for c in range(1, p):
                x, seen = (0, 1, 0), []  # x^i as (constant, linear, square)
                for i in range(1, order + 1):
                    if i < v + 1 and x[2] == 0:
                        seen.append(i % v)
                    if x == (1, 0, 0):
                        break
                    x = (x[2] * c % p, (x[0] + x[2] * b) % p, (x[1] + x[2] * a) % p)
                if i == order:
                    return v, np.array(sorted(set(seen)), dtype=np.int64)
    raise ValueError("no generator")  # there always is one


class Texts:
    """The distinct texts of a chunk that are long enough to repeat something."""

    def __init__(self, chunk: int, texts: list[bytes], window: int, v: int, cover: np.ndarray):
        self.chunk, self.window, self.sample = chunk, window, window - v + 1
        self.v, self.cover = v, cover
        rows: dict[bytes, int] = {}
        for text in texts:
            if len(text) >= window:
                rows[text] = rows.get(text, 0) + 1
        self.bytes, self.rows = list(rows), np.array(list(rows.values()), dtype=np.int64)
        names = [hashlib.blake2b(t, digest_size=16).digest() for t in self.bytes]
        self.ids = np.frombuffer(b"".join(names), dtype="<u8").reshape(-1, 2)

    def _hashes(self, text: bytes, places: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of the strings of a length at ascending places, in blocks."""
        data, out = np.frombuffer(text, dtype=np.uint8), []
        for base in range(0, len(data), BLOCK):
            a, b = np.searchsorted(places, [base, base + BLOCK])
            if a < b:
                at = places[a:b] - base
                out.append(spans(running(data[base:base + BLOCK + length]), at, at + length))
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)

    def _cover_places(self, text: bytes) -> np.ndarray:
        last = len(text) - self.sample
        periods = np.arange(0, last + 1, self.v)
        places = (periods[:, None] + self.cover).ravel()
        return places[places <= last]

    def _anchor_places(self, text: bytes) -> np.ndarray:
        places = np.arange(len(text) - self.sample + 1)
        marks = self._hashes(text, places, min(ANCHOR_BYTES, self.sample))
        return np.flatnonzero(marks & ANCHOR_MASK == 0)

    def samples(self) -> list[np.ndarray]:
        """Per text the fingerprints at cover places and at anchors; last, two
        numbers for each text as a whole, under the chunk's own name."""
        found = []
        self.places = []
        for text in self.bytes:
            cover, anchors = self._cover_places(text), self._anchor_places(text)
            self.places.append((cover, anchors))
            found.append(np.concatenate([self._hashes(text, at, self.sample) for at in (cover, anchors)]))
        return found + [mix(self.ids.ravel() ^ np.uint64(0x5851F42D4C957F2D))]

    def names(self, whole: bool) -> np.ndarray:
        own = self.ids[:, 0]
        if not whole:
            return own.copy()
        return np.append(own, mix(np.array([self.chunk], dtype="<i8").view("<u8")))

    def suffixes(self, tied: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per text the places that may start a repeat, and their fingerprints.
        ``tied`` answers what ``samples`` gave."""
        places, hashes = [], []
        for text, (cover, anchors), ties in zip(self.bytes, self.places, tied):
            met = cover[ties[:len(cover)]]
            at = np.empty(0, dtype=np.int64)
            if len(met):
                size = len(text) - self.window + 1
                untied = anchors[~ties[len(cover):]]
                open_ = self._reach(met, size) > 0
                at = np.flatnonzero(open_ & (self._reach(untied, size) == 0))
            places.append(at)
            hashes.append(self._hashes(text, at, self.window))
        return places, hashes

    def _reach(self, samples: np.ndarray, size: int) -> np.ndarray:
        """For every place how many of the samples lie inside its window."""
        steps = np.bincount(np.minimum(np.maximum(samples - (self.v - 1), 0), size), minlength=size + 1)
        steps -= np.bincount(np.minimum(samples + 1, size), minlength=size + 1)
        return np.cumsum(steps)[:size]

    def copied(self, whole: np.ndarray) -> np.ndarray:
        """Texts with a copy in this chunk or, by both numbers, in another."""
        return (self.rows > 1) | whole.reshape(-1, 2).all(axis=1)


def bucket_order(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket (texts stay in order inside one) and the buckets' edges."""
    where = (values >> np.uint64(40)).astype(np.int64) * buckets >> 24
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(buckets + 1))


def pairs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values to send, at most two of each, and for every value the number
    of its distinct value.

    Two in one chunk are a tie already, so a fingerprint that very many texts
    share costs its bucket two entries a chunk and not one a text.
    """
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[:len(values)]
    run = np.cumsum(new) - 1
    keep, number = np.empty(len(values), dtype=bool), np.empty(len(values), dtype=np.int64)
    keep[order] = np.arange(len(values)) - np.flatnonzero(new)[run] < 2
    number[order] = run
    return keep, number


def send(chunk: int, names: np.ndarray, per_text: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows (bucket, chunk, payload) of a chunk's fingerprints."""
    values = np.concatenate(per_text) if per_text else np.empty(0, dtype=np.uint64)
    text = np.repeat(np.arange(len(names)), [len(x) for x in per_text])
    keep, _ = pairs_of(values)
    values, text = values[keep], text[keep]
    order, edges = bucket_order(values, buckets)
    values, text = values[order], text[order]
    used = np.flatnonzero(np.diff(edges)).tolist()
    payloads = []
    for i in used:
        a, b = edges[i], edges[i + 1]
        counts = np.bincount(text[a:b], minlength=len(names))
        there = counts > 0
        payloads.append(put(names[there], counts[there], values[a:b]))
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()),
         pa.array(payloads, pa.binary())], ["bucket", "chunk", "payload"])


PAYLOADS = "bucket int, chunk bigint, payload binary"


def receive(bits: dict[int, bytes], per_text: list[np.ndarray], buckets: int) -> list[np.ndarray]:
    """Answers in the order of ``per_text``; every bucket that was sent must have answered."""
    everything = np.concatenate(per_text) if per_text else np.empty(0, dtype=np.uint64)
    keep, number = pairs_of(everything)
    values = everything[keep]
    order, edges = bucket_order(values, buckets)
    flags = np.zeros(len(values), dtype=bool)
    for i in np.flatnonzero(np.diff(edges)).tolist():
        n = int(edges[i + 1] - edges[i])
        found = np.unpackbits(np.frombuffer(bits[i], dtype=np.uint8))
        if not 0 <= len(found) - n < 8:
            raise ValueError("a bucket's answer does not fit its chunk")
        flags[edges[i]:edges[i + 1]] = found[:n]
    tied = np.zeros(int(number.max(initial=-1)) + 1, dtype=bool)
    tied[number[keep][order]] = flags
    out = tied[number]
    return np.split(out, np.cumsum([len(x) for x in per_text])[:-1]) if per_text else []


def sort_buckets(payloads: DataFrame) -> DataFrame:
    """(chunk, bucket, bits): for each fingerprint whether it is tied, with
    another text's or with another place of the same text."""

    def work(table: pa.Table) -> pa.Table:
        parts = [get(p) for p in table.column("payload").to_pylist()]
        values = np.concatenate([p[2] for p in parts])
        owner = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        source = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
        order = np.argsort(values, kind="stable")
        ranked, by, at = values[order], owner[order], source[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        # A text that several chunks hold is one text: another owner, or the
        # same chunk twice, makes a tie.
        tie = np.minimum.reduceat(by, first) != np.maximum.reduceat(by, first)
        twice = np.append(False, (ranked[1:] == ranked[:-1]) & (at[1:] == at[:-1]))
        tie |= np.logical_or.reduceat(twice, first)
        flags = np.empty(len(values), dtype=bool)
        flags[order] = np.repeat(tie, np.diff(np.append(first, len(ranked))))
        ends = np.cumsum([len(p[2]) for p in parts])[:-1]
        bits = [np.packbits(f).tobytes() for f in np.split(flags, ends)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                         "bits": pa.array(bits, pa.binary())})

    return payloads.groupBy("bucket").applyInArrow(work, "chunk bigint, bucket int, bits binary")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[bytes]]]:
    """Rows (row, text) in chunks: name, carried rows, texts.  A chunk is named by
    its content, so that evaluating the input again gives the same names."""

    def close(carried: list[pa.Array], texts: list[bytes]) -> tuple[int, pa.Array, list[bytes]]:
        own = pa.concat_arrays(carried)
        mark = hashlib.blake2b(repr(own.to_pylist()).encode(), digest_size=8)
        for text in texts:
            mark.update(text)
        return int.from_bytes(mark.digest(), "little", signed=True), own, texts

    carried, texts, size = [], [], 0
    for batch in batches:
        start = 0
        for i, text in enumerate(batch.column(1).cast(pa.binary())):
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                carried.append(batch.column(0).slice(start, i + 1 - start))
                yield close(carried, texts)
                carried, texts, size, start = [], [], 0, i + 1
        carried.append(batch.column(0).slice(start))
    if texts:
        yield close(carried, texts)


def chunked(rows: DataFrame) -> DataFrame:
    """(chunk, carried, lengths, body): rows (row, text) in chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, own, texts in gathered(batches):
            packed = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays([0, len(own)], own),
                 pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
                ["chunk", "carried", "lengths", "body"])

    schema = T.StructType([
        T.StructField("chunk", T.LongType()),
        T.StructField("carried", T.ArrayType(rows.schema["row"].dataType)),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("body", T.BinaryType())])
    return rows.mapInArrow(work, schema)


def unpack(row: dict) -> list[bytes]:
    total = sum(row["lengths"])
    body = pa.decompress(row["body"], decompressed_size=total, codec="zstd", asbytes=True)
    ends = np.cumsum(row["lengths"]).tolist()
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def remove_repeats(docs: DataFrame, carry: list[str], window: int = 400,
                   text_column: str = "text", as_text: bool = False) -> DataFrame:
    """Per row: the carried columns, n_bytes, n_removed, starts, ends (the
    maximal removed runs) and kept (the other bytes, which need not be whole
    characters; with ``as_text`` a string of the whole ones).

    A byte goes if a string of ``window`` bytes that covers it also starts
    anywhere else, in the same text or another; all is judged on the input.
    Null texts count as empty, shorter texts lose nothing, copies of a long
    text are removed whole, each of them; repeated rows are copies; the carried
    columns may hold nulls and are only passed on; an empty table gives no rows.
    Equality is that of 64-bit fingerprints.
    """
    v, cover = difference_cover(window)
    rows = docs.select(F.struct(*carry).alias("row"), whole_text(text_column).alias("text"))
    buckets = max(1, min(1 << 20, input_bytes(rows, "text") // BUCKET_BYTES))
    chunks = chunked(rows)

    # From the rows and not from the chunks: those would take a second Python
    # worker in each task, and its memory, beside the one that makes them.
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, own in gathered(batches):
            texts = Texts(chunk, own, window, v, cover)
            yield send(chunk, texts.names(whole=True), texts.samples(), buckets)

    tied = stored(sort_buckets(rows.mapInArrow(first, PAYLOADS)), "cover-ties")
    release(docs.sparkSession)

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.select(PACKED).to_pylist():
            texts = Texts(row["chunk"], unpack(row), window, v, cover)
            ties = receive(answers(right), texts.samples(), buckets)
            out.append(send(row["chunk"], texts.names(whole=False), texts.suffixes(ties)[1], buckets))
        return pa.Table.from_batches(out[:1], schema=EMPTY)

    def third(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[tuple] = []
        carried = pa.chunked_array([c.flatten() for c in left.column("carried").chunks]).combine_chunks() \
            if left.num_rows else pa.array([], left.schema.field("carried").type.value_type)
        rows = left.select(PACKED).to_pylist()
        for row in rows:
            everything = unpack(row)
            texts = Texts(row["chunk"], everything, window, v, cover)
            is_tie = right.column("step").to_numpy() == 1
            ties = receive(answers(right.filter(pa.array(is_tie))), texts.samples(), buckets)
            places, hashes = texts.suffixes(ties)
            repeats = receive(answers(right.filter(pa.array(~is_tie))), hashes, buckets)
            copied = texts.copied(ties[-1]) | (len(rows) > 1)  # the same chunk again: all copies
            found = {}
            for i, text in enumerate(texts.bytes):
                found[text] = cut(text, places[i][repeats[i]], window, bool(copied[i]))
            for text in everything:
                starts, ends, kept = found.get(text, ([], [], text))
                columns.append((len(text), len(text) - len(kept), starts, ends,
                                kept.decode(errors="ignore") if as_text else kept))
        lists = list(zip(*columns)) or [[]] * 5
        kinds = [*RESULT, pa.string() if as_text else pa.binary()]
        return pa.Table.from_arrays(
            [carried, *(pa.array(c, k) for c, k in zip(lists, kinds))],
            names=["row", "n_bytes", "n_removed", "starts", "ends", "kept"])

    answered = tied.select("chunk", "bucket", "bits")
    left = sort_buckets(
        chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(second, PAYLOADS))
    both = tied.withColumn("step", F.lit(1)).unionByName(left.withColumn("step", F.lit(2)))
    places = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("starts", places),
        T.StructField("ends", places),
        T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    found = chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(third, schema)
    return found.select("row.*", "n_bytes", "n_removed", "starts", "ends", "kept")


PACKED = ["chunk", "lengths", "body"]
EMPTY = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])
RESULT = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist()))


def cut(text: bytes, places: np.ndarray, window: int,
        copied: bool) -> tuple[list[int], list[int], bytes]:
    """Maximal runs covered by windows at the given places, and what is left."""
    if copied:
        return [0], [len(text)], b""
    if not len(places):
        return [], [], text
    new = np.append(True, places[1:] > places[:-1] + window)
    starts = places[new]
    ends = places[np.append(np.flatnonzero(new)[1:] - 1, len(places) - 1)] + window
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept.append(text[at:a])
        at = b
    return starts.tolist(), ends.tolist(), b"".join(kept) + text[at:]
