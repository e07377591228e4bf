"""Whole queries against plain re-computations and held-out labels."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.oracle_check import differences, open_tables

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def result(spark, name, sf):
    return entry.queries()[name](spark, sf).collect()


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_decontamination_equals_sql(spark):
    con = open_tables(MORE)
    df = entry.queries()["op8_decontamination"](spark, MORE)
    assert differences(df, con, entry.oracle_sql()["op8_decontamination"]) is None


@pytest.mark.parametrize("name", ["op4_url_filter", "op8_decontamination"])
def test_native_plans(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_token_counts(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = texts(spark, MORE)
    for r in result(spark, "op3_token_cache", MORE):
        n = len(tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"]) == (n, len(docs[r["doc_id"]].encode()))
        assert r["over_limit"] == (n > 512)


def test_packing(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs, pieces, filled = texts(spark, MORE), defaultdict(list), Counter()
    for r in result(spark, "op5_packing", MORE):
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]] += r["length"]
    for doc_id, text in docs.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for p in sorted(pieces[doc_id], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert all(n == 4096 or n & (n - 1) == 0 for n in filled.values())


def test_suffix_dedup(spark):
    docs, starts = {d: t.encode() for d, t in texts(spark, MORE).items()}, Counter()
    for t in docs.values():
        starts.update(t[i:i + 400] for i in range(len(t) - 399))
    for r in result(spark, "op6_suffix_dedup", MORE):
        t = docs[r["doc_id"]]
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 399):
            if starts[t[i:i + 400]] > 1:
                gone[i:i + 400] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_fingerprints(spark):
    docs = texts(spark, SMALL)
    order = sorted(docs)
    rows = {r["doc_id"]: r for r in result(spark, "op9_fingerprints", SMALL)}
    true, close = [], []
    for i, d in enumerate(order):
        following = order[(i + 1) % len(order)]
        n = len(docs[d]) // 4
        changed = docs[d][:len(docs[d]) - n] + docs[following][:n]
        assert rows[d]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b = (Counter(zip(w, w[1:])) for w in (docs[d].lower().split(), changed.lower().split()))
        if a and b:
            true.append(sum((a & b).values()) / sum((a | b).values()))
            close.append(rows[d]["near_edited"])
    error = np.array(true) - np.array(close)
    assert abs(error.mean()) < 0.02 and error.std() < 0.09


def test_near_duplicates(spark):
    docs = texts(spark, MORE)
    sets, parent = {}, {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for d in sorted(docs):
        w = docs[d].encode().lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        for other, n in Counter(o for s in sets[d] for o in held[s]).items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[other]) - n):
                a, b = find(d), find(other)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            held[s].append(d)
    for r in result(spark, "op10_jaccard_join", MORE):
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))


@pytest.mark.parametrize("name, column, least", [
    ("op1_quality", "quality", 0.97), ("op2_language", "lang", 0.97), ("op7_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, column, least):
    table = "documents" if column == "lang" else "labels"
    truth = {r["doc_id"]: r[column]
             for r in spark.read.parquet(f"{MORE}/{table}.parquet").select("doc_id", column).collect()}
    right = [
        truth[r["doc_id"]] == r["lang_pred" if column == "lang" else "predicted"]
        for r in result(spark, name, MORE) if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert sum(right) / len(right) >= least


def test_pipeline_is_its_operators(spark):
    """Each stage against the whole query of its operator over the stage's own input."""
    from pyspark.sql import functions as F

    from tillstream.llm import decontamination, jaccard_join, quality, suffix_dedup
    from tillstream.llm.common import remainder, stored, table

    docs = table(spark, SMALL, "documents")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SMALL), "test")
        outs.append((name, before, docs))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").distinct().collect()}
    _, before, after = outs[0]
    found = quality.rank_quality(before, table(spark, SMALL, "labels"), remainder("doc_id", 5) != 0)
    assert ids(after) == ids(found.where("predicted = 1"))
    _, before, after = outs[1]
    assert ids(after) == {r["component_id"] for r in jaccard_join.near_duplicates(before).collect()}
    _, before, after = outs[2]
    kept = {r["doc_id"]: bytes(r["kept"]).decode(errors="ignore")
            for r in suffix_dedup.remove_repeats(
                before, ["doc_id"], window=corpus_pipeline.REPEAT_BYTES).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == kept
    assert after.where(F.col("n_chars") != F.char_length("text")).count() == 0
    _, before, after = outs[3]
    clean = decontamination.contamination(before, table(spark, SMALL, "benchmark")).where("n_hit = 0")
    assert ids(after) == ids(clean)
    _, before, after = outs[4]
    assert ids(after) == ids(before)
    assert after.select("sequence_id", "offset").distinct().count() == after.count()
