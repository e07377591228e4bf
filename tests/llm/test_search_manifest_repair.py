"""Impact search, Merkle manifest and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle_check import differences, open_tables
from tillstream.llm import conversation_repair as repair
from tillstream.llm import impact_search as impact
from tillstream.llm import merkle

MORE = "/root/testdata/sf0.01"
NEW = ["op11_impact_search", "op12_merkle_manifest", "op13_conversation_repair"]


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql(spark, name):
    df = entry.queries()[name](spark, MORE)
    assert differences(df, open_tables(MORE), entry.oracle_sql()[name]) is None


# --- impact search ---------------------------------------------------------------------

def asked():
    return F.col("query") % 4 == 0


def plain_search(rows, k):
    """(query, rank, key, score) by sorting all scores; rows are (key, floors)."""
    out = []
    for i, (query, a) in enumerate(rows):
        if query is None or query % 4:
            continue
        scored = []
        for j, (key, b) in enumerate(rows):
            if i != j:
                score = sum(x * y for x, y in zip(a, b))
                scored.append((-max(-(1 << 63), min((1 << 63) - 1, score)), key is None, key or 0, key))
        out += [(query, rank, key, -score)
                for rank, (score, _, _, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found_by(spark, rows, k=5, schema="vec_id bigint, embedding array<double>"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    found = impact.search_all(df, "vec_id", "embedding", asked(), k)
    return sorted(((r["query"], r["rank"], r["key"], r["score"]) for r in found.collect()), key=repr)


def floors(rows):
    return [(key, [int(np.floor(64 * x)) for x in v]) for key, v in rows]


def test_search_with_ties_copies_and_several_chunks(spark, monkeypatch):
    draw = np.random.default_rng(3)
    base = draw.normal(0, 0.2, (60, 12))
    rows = [(i, [float(x) for x in base[i % 60] * (1 + (i % 3))]) for i in range(900)]
    assert found_by(spark, rows) == plain_search(floors(rows), 5)


def test_reading_stops_before_the_last_segment():
    """On clear cases the proof comes early, and the result is still whole."""
    draw = np.random.default_rng(4)
    matrix = np.clip(draw.normal(0, 8, (1500, 64)), -60, 60).astype(np.int64)
    chunk = impact.Chunk(dict(zip(
        ["chunk", "n", "width", "dtype", "ids", "known", "rows", "dims", "impacts", "ends"],
        impact._chunk(0, list(range(1500)), matrix.tolist()))), 64)
    scores = matrix[:40] @ matrix.T
    np.fill_diagonal(scores[:, :40], -(1 << 40))
    kth = np.sort(scores, axis=1)[:, -10].astype(float)
    best = impact.Best(kth.copy(), 10)
    read = impact.search_chunk(chunk, matrix[:40], np.arange(40), best)
    assert read < len(chunk.spans)
    for q in range(40):
        want = sorted((-s, v) for v, s in enumerate(scores[q]))[:10]
        assert [(-s, v) for s, v in zip(best.score[best.query == q], best.key[best.query == q])] == want


def test_search_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [3.0, -1.0]), (1, None),
        (8, [None, 1.0]), (12, [inf, 1.0]), (16, [nan, 1.0]), (20, []), (24, [0.0, 0.0]),
        (2, [0.5]), (3, [1.0, 1.0, 1.0]), (28, [-0.001, -5.0]),
    ]
    usable = [r for r in rows if r[1] is not None and all(
        x is not None and np.isfinite(x) for x in r[1])]
    wide = [(*r, 1, "x") for r in rows]
    schema = "vec_id bigint, embedding array<double>, n int, `a.b` string"
    assert found_by(spark, wide, 20, schema) == plain_search(floors(usable), 20)
    assert found_by(spark, [], 5) == []
    assert found_by(spark, [(4, [1.0])], 5) == []


def test_search_of_huge_components(spark):
    rows = [(0, [1e12, -3e9]), (4, [2e15, 1.0]), (1, [-1e12, 7.5]), (8, [1e4, 1e300])]
    limit = 1 << 62
    exact = [(k, [max(-limit, min(limit, int(np.floor(64 * x)))) for x in v]) for k, v in rows]
    assert found_by(spark, rows) == plain_search(exact, 5)


@pytest.mark.parametrize("queries, vectors", [(0, 0), (1, 20), (2500, 51_000), (4_000_000, 75_000_000)])
def test_cells_stay_bounded(queries, vectors):
    blocks, groups = impact.grid(queries, vectors)
    assert blocks * groups >= impact.CELLS
    assert queries * vectors / (blocks * groups) <= impact.CELL_PAIRS * 1.1


# --- Merkle manifest -------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests):
    """Root, and the siblings of every leaf from the leaf up."""
    groups, paths = [[i] for i in range(len(digests))], [[] for _ in digests]
    while len(digests) > 1:
        above, merged = [], []
        for i in range(0, len(digests), 2):
            run = digests[i:i + 2]
            for k, other in ((0, run[1:]), (1, run[:1])):
                for leaf in (groups[i + k] if k < len(run) else []):
                    paths[leaf] += other
            above.append(sha(*run))
            merged.append(list(itertools.chain(*groups[i:i + 2])))
        digests, groups = above, merged
    return digests[0], paths


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    """Multiset of (doc_id, leaf, subroot, root, siblings) of documents."""
    trees = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = sha(*map(written, (doc_id, source, lang, n_chars, text)))
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, doc_id))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: plain_tree([leaf for _, _, leaf, _ in sorted(trees[lang])]) for lang in langs}
    root, above = plain_tree([built[lang][0] for lang in langs])
    return sorted(
        (str(doc_id), leaf, built[lang][0], root, "".join(path + above[i]))
        for i, lang in enumerate(langs)
        for (_, _, leaf, doc_id), path in zip(sorted(trees[lang]), built[lang][1]))


def proved(spark, rows):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, pos int, tree string"
    docs = spark.createDataFrame([(*r, 7, "t") for r in rows], schema).repartition(4)
    return merkle.prove_documents(docs, F.col("doc_id") % 3 == 0).withColumn(
        "siblings", merkle.siblings(F.col("path"))).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 33, 300])
def test_manifest_of_n_leaves(spark, n):
    rows = [(i, "s", "en" if i % 5 else "de", i, f"text {i}") for i in range(1, n + 1)]
    got = proved(spark, rows)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.siblings) for r in got) == \
        plain_manifest(rows)
    assert all(r.verified == (r.doc_id % 3 != 0) for r in got)


def test_manifest_of_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, a language per row."""
    rows = [(None, None, None, None, None), (3, None, None, None, "x"), (3, "", "", 0, ""),
            (5, "s", "en", 2, "same"), (5, "s", "en", 2, "same"), (5, "s", "en", 3, "other"),
            (6, "s", "zä", 1, "ä" * 300_000), (9, "s", "en", (1 << 63) - 1, "most")]
    rows += [(100 + i, "s", f"l{i}", i, "t") for i in range(40)]
    got = proved(spark, rows)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.siblings) for r in got) == \
        plain_manifest(rows)
    changed = [r for r in got if not r.verified]
    # A null n_chars stays a null, so that leaf is not changed.
    assert sorted(r.doc_id for r in changed) == [3, 6, 9, *range(102, 140, 3)]
    assert proved(spark, []) == []


def test_nodes_are_nested(spark):
    rows = spark.createDataFrame(
        [(t, i, sha(str(i))) for t, n in (("a", 37), ("b", 1)) for i in range(n)],
        "tree string, key int, digest string")
    _, trees, _ = merkle.manifest(rows, ["key"])
    found = merkle.nodes(trees).collect()
    assert len([r for r in found if r.tree == "a"]) == 37 + 19 + 10 + 5 + 3 + 2 + 1
    for r in found:
        parents = [p for p in found if p.tree == r.tree and p.level == r.level + 1
                   and p.lo <= r.lo and r.hi <= p.hi]
        top = r.lo == 0 and r.hi == (37 if r.tree == "a" else 1) and not parents
        assert top or len(parents) == 1


# --- conversation repair ---------------------------------------------------------------

FOLLOW = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """The contract read literally, for turns of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not ink else "d" if (role, text) in seen
                      else "" if ink[-1] in ".!?" else "t")
        seen.add((role, text))

    @lru_cache(None)
    def cheapest(i, state, added):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        nxt = FOLLOW[state]

        def then(cost, letter, line, rest):
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1], line + rest[2]))

        if added < 2:
            then(5, "I", ((NAME[nxt], ""),), cheapest(i, nxt, added + 1))
        if i < len(rows):
            _, role, text = rows[i]
            then(2, "D", (), cheapest(i + 1, state, 0))
            if faults[i] not in ("b", "d"):
                cut = 5 if faults[i] == "t" else 0
                if role[:1] == nxt or (role[:1] == "s" and not state):
                    then(cut, "K", ((role, text),), cheapest(i + 1, role[:1], 0))
                then(1 + cut, "R", ((NAME[nxt], text),), cheapest(i + 1, nxt, 0))
        return min(found, key=lambda f: f[:2]) if found else None

    cost, audit, lines = cheapest(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *map(faults.count, "bdt"), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def plain_damage(rows):
    damaged = {}
    for conv, turn, role, text in rows:
        mine = damaged.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return damaged


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def repaired(df):
    turns = repair.repair_turns(repair.damage(df))
    return {r[0]: tuple(r)[1:] for r in repair.summarize(turns).collect()}


def test_repair_of_random_conversations(spark):
    draw = random.Random(5)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, ""]
    said = ["Hi.", "Hello", "What?\n", "Ok!", "  ", None, "", "a.b", "é ü ", "x. "]
    rows = [(None if conv == 17 else conv, draw.choice([t, t, t, t + 2, None, t - 1]),
             draw.choice(roles), draw.choice(said))
            for conv in range(1500) for t in range(draw.randint(1, 7))]
    got = repaired(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == {c: plain_repair(turns) for c, turns in plain_damage(rows).items()}


def test_repair_edges(spark):
    rows = [(1, None, None, None), (2, -(1 << 63), "user", "a."), (2, (1 << 63) - 1, "user", "b."),
            (3, 5, "user", "x" * 300_000 + "."), (3, 6, "assistant", "y")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", code int, `a.b` string")
    got = repaired(df)
    want = {c: plain_repair(t) for c, t in plain_damage(rows).items()}
    want[2] = (min(want[2][0], (1 << 63) - 1), *want[2][1:])
    assert got == want
    assert repaired(df.limit(0)) == {}


def test_a_conversation_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repaired(spark.createDataFrame([(gone, 0, "user", "hi.")], SCHEMA))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_giant_conversation_streams(spark):
    """60,000 turns of one conversation pass in batches; its shuffle is the only one."""
    df = spark.range(60_000).select(
        F.floor(F.col("id") / 100_000).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("turn "), F.col("id"), F.lit(".")).alias("text"))
    turns = repair.repair_turns(repair.keep_all(df))
    plan = turns._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    (row,) = repair.summarize(turns).collect()
    text = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:turn {i}." for i in range(60_000))
    assert (row.audit, row.cost) == ("K" * 60_000, 0)
    assert row.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "a."), (1, 2, "user", "b."), (1, 3, "user", "")]
    df = repair.keep_all(spark.createDataFrame(rows, SCHEMA))
    turns = [(r.edit, bytes(r.role).decode(), bytes(r.text).decode())
             for r in repair.repair_turns(df).collect()]
    assert turns == [("K", "system", "s."), ("K", "user", "a."), ("R", "assistant", "b."), ("D", "user", "")]
