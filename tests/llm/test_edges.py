"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import LONG
from tillstream.llm import (
    decontamination, fingerprints, jaccard_join, language, packing, quality, suffix_dedup,
    token_cache, tokens, toxicity, url_filter,
)
from tillstream.llm.common import remainder, scratch


def always():
    return F.lit(True)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_quality(odd, labels, empty):
    found = quality.rank_quality(odd, labels, always())
    assert ids(found) == ids(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.collect())
    assert quality.rank_quality(empty, labels, always()).count() == 0
    kept = quality.keep_good(odd, labels, always())
    assert kept.columns == odd.columns
    assert kept.count() == found.where("predicted = 1").count()


@pytest.mark.parametrize("only, score", [(1, 1.0), (0, 0.0), (None, 0.5)])
def test_quality_with_one_label(odd, labels, only, score):
    some = labels.where(F.col("quality") == only) if only is not None else labels.limit(0)
    found = quality.rank_quality(odd, some, always())
    assert all(abs(r["score"] - score) < 1e-3 for r in found.collect())


def test_language(odd, empty):
    found = {r["doc_id"]: r for r in language.identify(odd, always()).collect() if r["doc_id"]}
    assert [found[i]["lang_pred"] for i in (3, 4, 6, 7, 10)] == ["und"] * 5
    assert found[1]["lang_pred"] == "en" and found[5]["lang_pred"] == "de"
    assert ids(language.identify(odd, always())) == ids(odd)
    assert language.identify(empty, always()).count() == 0
    unlearned = language.identify(odd, F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlearned} == {("und", 0.0)}


def test_narrow_margins_are_rejected(odd):
    strict = language.identify(odd, always(), min_margin=2.0)
    assert not any(r["accepted"] for r in strict.collect())


def test_token_counts(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = scratch(spark, "test-cache")
    found = token_cache.count_tokens(odd, cache, path)
    counts = {r["doc_id"]: r for r in found.collect()}
    assert ids(found) == ids(odd)
    assert (counts[3]["n_bytes"], counts[3]["n_tokens"], counts[4]["n_tokens"]) == (0, 0, 0)
    assert counts[5]["n_bytes"] == len(LONG)
    stored = spark.read.parquet(cache)
    assert stored.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    again = token_cache.count_tokens(odd, cache, path)
    assert rows_of(again) == rows_of(found)
    assert spark.read.parquet(cache).count() == stored.count()  # nothing was missing
    assert token_cache.count_tokens(empty, scratch(spark, "test-cache"), path).count() == 0


def test_urls(spark):
    rules = [url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"),
             url_filter.Rule("org/fr/", "allow")]
    urls = [None, "", "no scheme", "http://NET/x", "https://a.example.net/en/1?q=1#f", "http://net",
            "http://x.org/fr/", "http://x.org/fr/", "ftp://é.com/" + "a/" * 5000, "://", "http://xnet/a",
            "http://a.net?b=://c"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}
    assert [got[i]["host"] for i in range(6)] == ["", "", "", "net", "a.example.net", "net"]
    assert [got[i]["rule"] for i in range(7)] == [None] * 3 + ["net/", "example.net/en/", None, "org/fr/"]
    assert got[11]["host"] == "a.net" and got[11]["path"] == "" and got[11]["rule"] is None
    assert got[10]["rule"] is None and len(got) == len(urls)
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    alone = url_filter.judge(pages.where("page_id in (0, 3)"), rules).collect()
    assert {r["verdict"] for r in alone} == {"block"}
    nothing = url_filter.judge(pages.where("page_id < 3"), rules).collect()
    assert {r["verdict"] for r in nothing} == {"allow"}


def test_packing(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(odd, path, end_id=2, capacity=64, block_tokens=500).collect()
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == ids(odd)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
    for members in sequences.values():
        members.sort(key=lambda p: p["offset"])
        ends = [p["offset"] + p["length"] for p in members]
        assert [p["offset"] for p in members] == [0, *ends[:-1]]
        assert ends[-1] <= 64 and (ends[-1] == 64 or ends[-1] & (ends[-1] - 1) == 0)
    assert packing.pack(empty, path, end_id=2).count() == 0


def test_suffixes(odd, empty):
    found = suffix_dedup.remove_repeats(odd, ["doc_id"], window=20).collect()
    got = {r["doc_id"]: r for r in found}
    assert Counter(r["doc_id"] for r in found) == ids(odd)
    assert got[1]["kept"] == got[2]["kept"] == got[8]["kept"] == b""  # copies go
    assert got[3]["n_bytes"] == 0 and bytes(got[9]["kept"]) != b""
    assert (got[5]["n_removed"], got[5]["starts"]) == (len(LONG), [0])
    assert suffix_dedup.remove_repeats(empty, ["doc_id"]).count() == 0


def test_toxicity(odd, labels, empty):
    for some in (labels, labels.where("toxic = 1"), labels.where("toxic = 0"), labels.limit(0)):
        found = toxicity.score_toxicity(odd, some, always())
        assert ids(found) == ids(odd)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
                   for r in found.collect())
    assert toxicity.score_toxicity(empty, labels, always()).count() == 0


def test_contamination(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, "QUICK brown fox"), (2, None), (3, ""), (None, "short"), (4, "12"), (5, "12"),
         (6, "ipsum lorem " * 10), (7, "not in any document at all here or there")],
        "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontamination.contamination(odd, items).collect()}
    assert (got[1, 12]["n_hit"], got[1, 12]["items"]) == (3, ["1"])
    assert (got[7, 2]["n_hit"], got[7, 2]["items"]) == (1, ["4", "5"])
    assert got[9, 1]["items"] == [""] and got[3, 0]["n_hit"] == 0
    assert got[5, 60000]["n_hit"] == 60000 and got[5, 60000]["items"] == ["6"]
    assert ids(decontamination.contamination(odd, items)) == ids(odd)
    assert decontamination.contamination(empty, items).count() == 0
    none = decontamination.contamination(odd, items.limit(0)).collect()
    assert {r["n_hit"] for r in none} == {0}
    kept = decontamination.keep_clean(odd, items)
    assert kept.columns == odd.columns and 1 not in ids(kept) and ids(kept)[9] == 1
    assert decontamination.keep_clean(odd, items.limit(0)).count() == odd.count()


def test_fingerprints(odd, empty):
    found = fingerprints.fingerprint_documents(odd, slice_bytes=1 << 16)
    got = found.collect()
    assert Counter(r["doc_id"] for r in got) == ids(odd)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0
    assert by[3]["near_next"] == 1.0 and by[3]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[5]["n_chars"] == len(LONG)
    assert fingerprints.fingerprint_documents(empty).count() == 0
    one = fingerprints.fingerprint_documents(odd.where("doc_id = 1")).collect()
    assert one[0]["near_next"] == 1.0


def test_near_duplicates(odd, empty):
    found = jaccard_join.near_duplicates(odd)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found.collect()}
    assert ids(found) == ids(odd)
    assert got[1, 8] == got[2, 8] == 1 and got[5, 2] == 5
    assert [got[i, 0] for i in (3, 4, 6, 10)] == [3, 4, 6, 10]
    assert got[None, 1] is None
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = jaccard_join.keep_first(odd)
    assert kept.columns == odd.columns
    assert ids(kept) == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 2, 10: 1, None: 1}


def test_pipeline_stages(spark, odd, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    for table in (odd.withColumn("n_chars", F.char_length("text").cast("long")),
                  odd.withColumn("n_chars", F.lit(1).cast("long")).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            out.collect()
            assert out.columns == table.columns or name == names[-1]


def test_splits_do_not_depend_on_nulls(odd):
    got = odd.select("doc_id", remainder("doc_id", 5).alias("r")).distinct().collect()
    assert all(r["r"] is not None for r in got)


def test_contamination_reads_texts_once(spark, odd, tmp_path):
    """Numbers of words come from the pass that looks for shingles, one for each row."""
    odd.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    items = spark.createDataFrame([(1, "QUICK brown fox"), (4, "12"), (5, "an other")], "item_id long, text string")
    found = decontamination.contamination(docs, items)
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    assert ids(found) == ids(odd)
    assert {r["doc_id"]: r["n_words"] for r in found.collect() if r["doc_id"] in (3, 4, 5, 6, 7, 8)} == {
        3: 0, 4: 0, 5: 60000, 6: 0, 7: 2, 8: 7}


def test_words(spark):
    texts = ["", " ", "--", "a", " A-b ", "ÄÖ É\U0001f600x,Y", "x\x00y\x7f", "\n1\t2\n", "a--b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in rows.select(decontamination.words(F.col("text"))).collect()]
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    assert got == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(low)) for t in texts]


def test_pieces_of_many_texts_at_once():
    """Ids as the library gives them, also where hardly any piece is remembered."""
    encoder = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"), False, keep=3)
    texts = ["a b a", "", " ", "one, two. (three)", " lead\ttail \r\n", "ÄÖ ß é́ \U0001f600", "a\x0bb",
             "x\x00y", "a<|endoftext|>b", "no\xa0break", "a " * 500, "\n"]
    for _ in range(2):
        for i in range(len(texts)):
            assert encoder.each(texts[i:]) == [encoder._library(t).tobytes() for t in texts[i:]]
        assert len(encoder.young) <= 3
    assert encoder.each([]) == []
