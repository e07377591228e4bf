"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n^2`` (attention).  Pieces
are taken in descending cost and each goes to the sequence of lowest cost that
still has room; where none has room for all of it, it is cut and fills what is
left.  Blocks of documents are packed as they stream through a task, what does
not fill a sequence is carried to the next block, and the last rest of a task
goes to sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm import tokens
from tillstream.llm.common import whole_text

PIECES = pa.schema([
    ("row_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
PIECES_SQL = ("row_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
              "sequence_id bigint, offset bigint")
SEQUENCES_PER_TASK = 1 << 36
# Half of the pieces that a worker remembers.
KEPT_PIECES = 300_000
# Texts whose pieces are numbered together have about so many characters.
SLICE_CHARS = 4 << 20

Piece = tuple[int, int, int]  # document (place in the block), start, length


def balance(pieces: list[Piece], sizes: list[int], linear: float,
            quadratic: float) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill sequences of the given sizes; what finds no room comes back.

    Descending cost, ties by place.  The chosen sequence is the cheapest with
    room for the whole piece, else the cheapest with any room.
    """
    sequences: list[list[Piece]] = [[] for _ in sizes]
    room = np.array(sizes, dtype=np.int64)
    cost = np.zeros(len(sizes))
    rest: list[Piece] = []
    total = int(room.sum())
    for doc, start, length in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        while length and total:
            fits = room >= length
            if not fits.any():
                fits = room > 0
            at = int(np.where(fits, cost, np.inf).argmin())
            part = min(length, int(room[at]))
            sequences[at].append((doc, start, part))
            room[at] -= part
            total -= part
            cost[at] += linear * part + quadratic * part * part
            start, length = start + part, length - part
        if length:
            rest.append((doc, start, length))
    return sequences, rest


def powers_of_two(n: int) -> list[int]:
    """Descending powers of two that add up to n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs one task's documents; holds one block at a time."""

    def __init__(self, capacity: int, linear: float, quadratic: float, first_sequence: int):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic
        self.next_sequence = first_sequence
        self.docs: list[tuple[int | None, bytes]] = []
        self.pieces: list[Piece] = []
        self.size = 0

    def add(self, row_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        place = len(self.docs)
        self.docs.append((row_id, ids))
        self.pieces += [(place, s, min(self.capacity, n - s)) for s in range(0, n, self.capacity)]
        self.size += n

    def flush(self, last: bool) -> pa.RecordBatch:
        full = [[p] for p in self.pieces if p[2] == self.capacity]
        parts = [p for p in self.pieces if p[2] < self.capacity]
        left = sum(p[2] for p in parts)
        made, rest = balance(parts, [self.capacity] * (left // self.capacity),
                             self.linear, self.quadratic)
        if last:
            ends, rest = balance(rest, powers_of_two(left % self.capacity),
                                 self.linear, self.quadratic)
            made += ends
        rows = []
        for sequence in full + made:
            offset = 0
            for place, start, length in sequence:
                row_id, ids = self.docs[place]
                rows.append((row_id, start, length, ids[4 * start:4 * (start + length)],
                             len(ids) // 4, self.next_sequence, offset))
                offset += length
            self.next_sequence += 1
        kept = sorted({p[0] for p in rest})
        places = {old: new for new, old in enumerate(kept)}
        self.docs = [self.docs[i] for i in kept]
        self.pieces = [(places[d], s, n) for d, s, n in rest]
        self.size = sum(p[2] for p in rest)
        columns = list(zip(*rows)) or [[] for _ in PIECES]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES
        )


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096,
         spaces_kept: bool = False, linear: float = 1.0, quadratic: float = 1.0 / 2048,
         block_tokens: int = 1 << 20, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """Pieces with their ids: id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.

    A document is its tokens and ``end_id``, so a null or empty text is one
    token, and a text of any length is cut into pieces of at most ``capacity``.
    Rows are packed as rows: repeated rows and null ids included; only the id and
    the text are read, so other columns may have any names; an empty table gives
    no pieces.  Nothing is shuffled: each task packs what it
    reads, and its sequences are numbered from its partition number, so a task
    that runs again gives the same pieces.
    """
    closing = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path, spaces_kept, keep=KEPT_PIECES)
        packer = Packer(capacity, linear, quadratic,
                        TaskContext.get().partitionId() * SEQUENCES_PER_TASK)
        for batch in batches:
            row_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tokens.slices(texts, SLICE_CHARS):
                for row_id, ids in zip(row_ids[a:b], encoder.each(texts[a:b])):
                    packer.add(row_id, ids + closing)
                    if packer.size >= block_tokens:
                        yield packer.flush(last=False)
        yield packer.flush(last=True)

    rows = docs.select(
        F.col(id_column).cast("long").alias("row_id"), whole_text(text_column).alias("text")
    )
    return rows.mapInArrow(work, PIECES_SQL).withColumnRenamed("row_id", id_column)
