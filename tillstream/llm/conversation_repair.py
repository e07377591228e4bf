"""Repair of conversation structure by the cheapest edits, in a sorted stream.

A conversation is read as ``(s?(ua)+)?``: an optional system turn, then user and
assistant turns by pairs, or nothing.  Keeping a turn costs 0, giving it the role
user or assistant 1, deleting it 2, inserting an empty user or assistant turn 5,
and a truncated turn that is not deleted 5 more.  Blank and repeated turns have
to be deleted.  Of the cheapest edits those count whose initials (D, I, K, R),
written in order, are first in ASCII.

Rows are shuffled once, by conversation, and stay in their partition:

1. Sorted by role, text and turn, they get the number of their repetition.
2. Sorted by turn from the end, ``mapInArrow`` carries the cost of repairing the
   rest from each of four states over batches.  Four choices of two bits make
   one byte per row: the back pointers.  They travel with their rows into
   Spark's own sort, which spills to disk, so that a giant conversation needs
   no memory of its own.
3. Sorted from the start, a second pass follows the choices and gives the edits.

The state says what must come next, so the letters of two edits at one place
differ and the smallest letter that keeps the cost decides ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
# Costs of the edits and of a truncated turn that stays.
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
CUT = 5

# States: nothing yet, after a system, a user and an assistant turn.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # where a user or assistant turn leads
ROLE_AT = ("user", "user", "assistant", "user")
END = (0, 10, 5, 0)  # cost of ending in each state, by insertions
LONG = (-(1 << 63), (1 << 63) - 1)


def _take(state: int, kind: int) -> int | None:
    """State after keeping a turn of this kind; None where it cannot stand."""
    if kind == SYSTEM:
        return AFTER_S if state == START else None
    wanted = ASSISTANT if state == AFTER_U else USER
    return NEXT[state] if kind == wanted else None


def step_back(rest: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """Costs before a turn from the costs after it, and the four choices as a byte.

    ``code`` is ``4 * fault + kind`` of the turn.
    """
    fault, kind = divmod(code, 4)
    cut = CUT if fault == TRUNCATED else 0
    options = []
    for state in range(4):
        of = {DELETE: COSTS[DELETE] + rest[state]}
        if fault not in (BLANK, DUPLICATE):
            kept = _take(state, kind)
            if kept is not None:
                of[KEEP] = COSTS[KEEP] + cut + rest[kept]
            of[REROLE] = COSTS[REROLE] + cut + rest[NEXT[state]]
        options.append(of)
    plain = [min(of.values()) for of in options]
    # Two insertions in a row come back to a state at a cost, one is enough.
    best = [min(plain[s], COSTS[INSERT] + plain[NEXT[s]],
                2 * COSTS[INSERT] + plain[NEXT[NEXT[s]]]) for s in range(4)]
    choices = 0
    for state in range(4):
        options[state][INSERT] = COSTS[INSERT] + best[NEXT[state]]
        choice = min(k for k, cost in options[state].items() if cost == best[state])
        choices |= choice << (2 * state)
    return tuple(best), choices


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Choices for rows that come conversation by conversation from the end.

    The costs are carried less their smallest, of which there are few, so each
    step is computed once for a pair of costs and turn.
    """
    known: dict[tuple, tuple] = {}
    current, rest, back = object(), END, 0
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        codes = batch.column("code").to_pylist()
        choices, backs = np.empty(len(ids), dtype=np.int16), np.empty(len(ids), dtype=np.int64)
        for i, (conv, code) in enumerate(zip(ids, codes)):
            if conv != current:
                current, rest, back = conv, END, 0
            if code is None:  # a dropped row
                choices[i] = -1
            else:
                found = known.get((rest, code))
                if found is None:
                    best, choice = step_back(rest, code)
                    least = min(best)
                    found = known[rest, code] = tuple(b - least for b in best), choice
                rest, choices[i] = found
            backs[i] = back
            back += 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(choices), pa.array(backs)],
            names=[*batch.schema.names, "choice", "back"])


TURNS = ("conv_id bigint, turn bigint, edit string, role binary, text binary, "
         "kind int, fault int, inserted boolean")


def _turns(schema: pa.Schema):
    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edited turns in order: the choices are followed from the start."""
        current, state = object(), START
        for batch in batches:
            rows: list[tuple] = []

            def close(conv, state) -> None:
                while state in (AFTER_S, AFTER_U):
                    rows.append((conv, None, "I", ROLE_AT[state].encode(), b"", None, None, True))
                    state = NEXT[state]

            columns = [batch.column(c).to_pylist() for c in (
                "conv_id", "turn", "role", "text", "code", "choice")]
            for conv, turn, role, text, code, choices in zip(*columns):
                if conv != current:
                    close(current, state)
                    current, state = conv, START
                if code is None:
                    rows.append((conv, None, None, None, None, None, None, False))
                    continue
                fault, kind = divmod(code, 4)
                while (choice := choices >> (2 * state) & 3) == INSERT:
                    rows.append((conv, None, "I", ROLE_AT[state].encode(), b"", None, None, True))
                    state = NEXT[state]
                if choice == REROLE:
                    role = ROLE_AT[state].encode()
                rows.append((conv, turn, LETTERS[choice], role, text, kind, fault, False))
                if choice == KEEP:
                    state = _take(state, kind)
                elif choice == REROLE:
                    state = NEXT[state]
            yield _table(rows, schema)
        rows = []
        while state in (AFTER_S, AFTER_U):
            rows.append((current, None, "I", ROLE_AT[state].encode(), b"", None, None, True))
            state = NEXT[state]
        if rows:
            yield _table(rows, schema)

    return forwards


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


_TURN_FIELDS = (
    ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.binary()), ("text", pa.binary()),
    ("kind", pa.int32()), ("fault", pa.int32()), ("inserted", pa.bool_()))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the crc32 of ``conv_id:turn`` modulo 20 plants.

    0 drops the row, 1 empties its text, 2 takes its ``.``, ``!`` and ``?`` out, 3
    repeats it, 4 makes it a user's.  Nulls are read as one space.  A dropped row
    stays as a row with ``dropped``, so that its conversation is known.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("__kind") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", kind.alias("__kind"), role.alias("role"), text.alias("text"),
    ).select(
        "conv_id", "turn",
        F.when(F.col("__kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("__kind").isin(0, 1), F.lit(""))
        .when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        (F.col("__kind") == 0).alias("dropped"), F.explode(copies).alias("__copy"),
    ).drop("__copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Rows with ``copy`` (number among equal role and text) and ``code``."""
    initial = F.substring("role", 1, 1)
    kind = (F.when(initial == "s", SYSTEM).when(initial == "u", USER)
            .when(initial == "a", ASSISTANT).otherwise(OTHER))
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(
        F.asc_nulls_first("turn"))
    inked = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))  # without the spaces of the contract
    fault = (F.when(inked == "", BLANK).when(F.col("copy") > 1, DUPLICATE)
             .when(~F.substring(inked, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE))
    return rows.withColumn("copy", F.row_number().over(same)).withColumn(
        "code", F.when(~F.col("dropped"), fault * 4 + kind).cast("int"))


def repair_turns(rows: DataFrame) -> DataFrame:
    """The turns of all conversations with their edits, one conversation after
    the other and in order inside a partition.

    ``rows`` has ``conv_id`` (bigint or string), ``turn``, ``role``, ``text`` and
    ``dropped``; other columns are not read.  Returns ``conv_id, turn, edit, role,
    text`` (after the edit, as UTF-8 bytes; a deleted turn keeps its own),
    ``kind, fault`` (before it) and ``inserted``; a dropped row comes back with
    ``edit`` null.

    Turns ascend, nulls first; turns that agree in number follow one another by
    role, text and repetition.  A null conversation is one of its own, a null
    role or text counts as one space, a role of unknown initial can only be
    changed or deleted.  Texts may be empty or of any length, an empty table
    gives no rows.
    """
    space = F.lit(" ")
    rows = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        "dropped")
    placed = _faults(rows.repartition("conv_id")).sortWithinPartitions(
        F.asc("conv_id"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("copy"))
    compact = placed.select(
        "conv_id", "turn", F.col("role").cast("binary").alias("role"),
        F.col("text").cast("binary").alias("text"), "code")
    kind = compact.schema["conv_id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    plan = compact.mapInArrow(
        _backwards, f"conv_id {kind}, turn bigint, role binary, text binary, code int, "
                    "choice smallint, back bigint")
    ordered = plan.sortWithinPartitions(F.asc("conv_id"), F.desc("back"))
    schema = pa.schema([("conv_id", arrow), *_TURN_FIELDS])
    return ordered.mapInArrow(_turns(schema), TURNS.replace("bigint", kind, 1))


SUMMARY = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
           "illegal bigint, cost bigint, audit string, repaired_sha256 string")
_PAIRS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class _Summary:
    """Counts of one conversation; its edits are kept as one byte a turn."""

    def __init__(self, conv) -> None:
        self.conv, self.audit, self.hash, self.written = conv, bytearray(), hashlib.sha256(), False
        self.first = self.last = self.before = None
        self.distinct = self.illegal = self.cost = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn, edit, role, text, kind, fault, inserted) -> None:
        if edit is None:
            return
        self.audit += edit.encode()
        self.cost += COSTS[LETTERS.index(edit)] + (CUT if fault == TRUNCATED and edit != "D" else 0)
        if edit != "D":
            self.hash.update((b"\n" if self.written else b"") + role + b":" + text)
            self.written = True
        if inserted:
            return
        self.faults[fault] += 1
        if self.before is not None and (self.before, kind) not in _PAIRS:
            self.illegal += 1
        self.before = kind
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv, min(gaps, LONG[1]), *self.faults[1:], self.illegal, self.cost,
                self.audit.decode(), self.hash.hexdigest())


def summarize(turns: DataFrame) -> DataFrame:
    """One row per conversation from the turns as ``repair_turns`` gives them.

    Nothing may be between the two that moves rows: the turns are read as a
    stream in their order.  Gaps beyond a long count as its largest value.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    schema = pa.schema([("conv_id", arrow), *[(c, pa.int64()) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one: _Summary | None = None
        for batch in batches:
            done = []
            for conv, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if open_one is None or conv != open_one.conv:
                    if open_one is not None:
                        done.append(open_one.row())
                    open_one = _Summary(conv)
                open_one.add(*rest)
            if done:
                yield _table(done, schema)
        if open_one is not None:
            yield _table([open_one.row()], schema)

    return turns.mapInArrow(stream, SUMMARY.replace("bigint", kind, 1))


def keep_all(rows: DataFrame) -> DataFrame:
    """Rows none of which is dropped, as input of ``repair_turns``."""
    return rows.withColumn("dropped", F.lit(False))


