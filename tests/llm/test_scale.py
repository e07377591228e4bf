"""Properties that short texts and small tables do not show."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillstream.llm import common, fingerprints, jaccard_join, suffix_dedup, tokens


@pytest.mark.parametrize("shared", [0, 30_000, 60_000])
def test_likeness_of_long_texts(shared):
    """Texts of 80,000 words against the generalised Jaccard of their two-word terms."""
    random = np.random.Generator(np.random.PCG64(5))
    words = [f"w{i}" for i in random.zipf(1.3, 240_000) % 40_000]
    a = words[:80_000]
    b = words[:shared] + words[80_000:160_000 - shared]
    x, y = (Counter(zip(w, w[1:])) for w in (a, b))
    true = sum((x & y).values()) / sum((x | y).values())
    sampler = fingerprints.Sampler(1024)
    close = fingerprints.likeness(sampler.of(" ".join(a)), sampler.of(" ".join(b)))
    assert abs(close - true) < 4 * max(true * (1 - true), 0.01) ** 0.5 / 32


def linked(texts, size=5, percent=75):
    """Smallest id of each text's component, by comparing all pairs."""
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
    least = {d: d for d in texts}
    for _ in texts:
        before = dict(least)
        for a in texts:
            for b in texts:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def components_of(docs):
    return {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}


def test_payloads_do_not_grow_with_texts_times_ranges(spark, monkeypatch):
    random = np.random.Generator(np.random.PCG64(6))
    texts = {i: " ".join(f"w{x}" for x in random.integers(0, 10_000, 24)) for i in range(120)}
    for i in range(0, 100, 10):
        texts[i + 1] = texts[i] + " end"
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    payloads = jaccard_join.range_payloads(docs, 5, 400)
    moved = payloads.selectExpr("sum(octet_length(payload))").first()[0]
    back = jaccard_join.shared_shingles(payloads).selectExpr("sum(octet_length(payload))").first()[0]
    hashes = sum(len(t.split()) - 4 for t in texts.values())
    assert moved < 32 * hashes and back < 32 * hashes
    monkeypatch.setattr(jaccard_join, "RANGE_BYTES", 64)
    assert components_of(docs) == linked(texts)


def groups_of_searches(monkeypatch):
    """The bytes of the largest group of each search, in a list that fills up."""
    found, search = [], jaccard_join.search

    def watched(questions, percent):
        sizes = questions.groupBy("list", "part").agg(F.sum(F.octet_length("shared")).alias("n"))
        found.append(sizes.agg(F.max("n")).first()[0] or 0)
        return search(questions, percent)

    monkeypatch.setattr(jaccard_join, "search", watched)
    return found


@pytest.mark.parametrize("kind", ["passage", "families"])
def test_hot_lists_keep_groups_small(spark, monkeypatch, kind):
    """A passage in very many unlike texts, and families of texts around the
    threshold, against all pairs."""
    random = np.random.Generator(np.random.PCG64(7))

    def words(n):
        return [f"w{x}" for x in random.integers(0, 1 << 40, n)]

    if kind == "passage":
        hot = words(80)
        texts = {i: " ".join(hot + words(15 + i % 12)) for i in range(150)}
        for i in range(0, 60, 12):
            texts[i + 200] = texts[i] + " end"
    else:
        hot, texts = words(40), {}
        for family in range(3):
            base = hot + words(50)
            for i in range(30):
                start = int(random.integers(40, 80))
                texts[100 * family + i] = " ".join(
                    base[:start] + words(int(random.integers(1, 12))) + base[start + int(random.integers(0, 8)):])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 8_000)
    groups = groups_of_searches(monkeypatch)
    assert components_of(docs) == linked(texts)
    assert max(groups) < 3 * 8_000


def test_near_duplicates_write_few_files(spark, monkeypatch):
    """Of few texts, however many partitions the session shuffles to."""
    rng = random.Random(5)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(10 ** 9)}" for _ in range(60)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[1:])), (3 * i + 2, " ".join(words[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    paths, scratch = [], common.scratch
    monkeypatch.setattr(common, "scratch", lambda s, name: paths.append(scratch(s, name)) or paths[-1])
    hot = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in hot}
    for k, v in hot.items():
        spark.conf.set(k, v)
    try:
        found = jaccard_join.near_duplicates(docs)
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i // 3 * 3 for i, _ in rows}
        assert found.rdd.getNumPartitions() <= jaccard_join.LEAST_FILES
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    folders = [Path(p.removeprefix("file://").removeprefix("file:")) for p in paths]
    written = {f.name: len(list(f.glob("part-*"))) for f in folders}
    assert len(written) > 10 and max(written.values()) <= jaccard_join.LEAST_FILES, written


def test_fingerprints_work_out_shared_terms_once(monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts = ["", "one", "a b a b a b c", " Σ\tΑΣ\x0bΑΣ Α\n\nΣ. ", "x" * 999 + " y ", "ab " * 9000] + [" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(40)]
    sample, worked = fingerprints.Sampler(), []
    alone = [sample.of(t).tobytes().hex() for t in texts]
    changed = [sample.of(fingerprints.edited(a, b)).tobytes().hex() for a, b in zip(texts, texts[1:])]
    numbers = fingerprints.Sampler.numbers
    monkeypatch.setattr(fingerprints.Sampler, "numbers", lambda self, terms, *a: worked.append(len(terms)) or numbers(self, terms, *a))
    monkeypatch.setattr(fingerprints, "TERMS_HELD", 1000)
    group = fingerprints.Group(sample)
    for i, text in enumerate(texts):
        group.add(i, text, 0, False)
    every = [group.rows[-1].terms] + [x for r in group.rows[:-1] for x in (r.terms, r.changed)]
    found = group.closed().to_pylist()
    assert [r["fingerprint"] for r in found] == alone[:-1]
    assert [r["edited_fingerprint"] for r in found] == changed
    assert sum(worked) == len({tw for terms, weights in every for tw in zip(terms.tolist(), weights.tolist())})


def test_pieces_that_differ_in_case_are_one():
    """Some marks compose with small letters only, and the tokenizer composes first."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokens.load(path)
    plain = "The the THE tHe, the, don't DON'T Ünder ünder ÜNDER İstanbul ΣΑΣ K K"
    marks = "J̌ ǰ H̱ T̈he Y̊ W̊ Á İ the"
    for texts in ([plain], [marks], [plain, marks, "", "The <|endoftext|> the", "x\x0bY"]):
        encoder = tokens.PieceEncoder(path, spaces_kept=False)
        found = [np.frombuffer(x, "<u4").tolist() for x in encoder.each(texts)]
        assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = tokens.PieceEncoder(path, spaces_kept=False)
    list(encoder.each([plain]))
    assert "the" in encoder.young and not {"The", "THE"} & set(encoder.young)


def test_fingerprints_are_made_by_the_worker_that_reads_the_texts(spark, monkeypatch):
    """One Python worker a task: a second one beside it would double the memory."""
    plans, write = [], suffix_dedup.stored

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(suffix_dedup, "stored", stored)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 300)
    draw = random.Random(11)
    texts = [" ".join(draw.choices("abcdefgh", k=60)) for _ in range(20)]
    texts += [texts[0][:70] + " end é", texts[1], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    got = {r["i"]: (r["n_bytes"], bytes(r["kept"]).decode())
           for r in suffix_dedup.remove_repeats(df, ["i"], window=50).collect()}
    left = [t or "" for t in texts]
    left[0], left[1], left[20], left[21] = texts[0][70:], "", texts[20][70:], ""
    assert got == {i: (len((t or "").encode()), left[i]) for i, t in enumerate(texts)}
    assert [p.count("MapInArrow") for p in plans] == [1]


def test_the_pipeline_carries_a_text_once(spark, monkeypatch):
    carried, remove = [], suffix_dedup.remove_repeats

    def watched(docs, *args, **kwargs):
        carried.append(docs.schema["doc"].dataType.names)
        return remove(docs, *args, **kwargs)

    monkeypatch.setattr(suffix_dedup, "remove_repeats", watched)
    rows = [(1, "a b" * 100, 300, None), (2, "short", 5, "x"), (None, None, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, `a.b` string")
    found = corpus_pipeline.cut_repeats(spark, docs, "")
    assert found.columns == docs.columns and carried == [["doc_id", "n_chars", "a.b"]]
    assert sorted(map(tuple, found.collect()), key=str) == [
        (1, "", 0, None), (2, "short", 5, "x"), (None, "", 0, "y")]
    alone = corpus_pipeline.cut_repeats(spark, docs.select("text"), "")
    assert sorted(r["text"] for r in alone.collect()) == ["", "", "short"]
