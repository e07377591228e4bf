"""Toxicity by weak supervision.

Voters are learned lexicon entries (words), learned patterns (word beginnings)
and fixed patterns.  A generative label model, fitted by EM without labels,
estimates how often each voter speaks on toxic and on clean texts (accuracies)
and how voters move together within a class (correlations); voters that say the
same thing share their weight.  Its posteriors then train a linear classifier
on many more terms, which scores every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillstream.llm.common import whole_text

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
PREFIXES = (4, 5, 6, 7, 8)
CANDIDATES = 3000


def terms(text: str) -> set[str]:
    """Words without punctuation at their ends, and beginnings of words marked
    with ``*``; pattern terms start with a blank."""
    words = set(text.lower().split())
    clean = {w if w.isalpha() else EDGES.sub("", w) for w in words}
    clean.discard("")
    out = set(clean)
    for n in PREFIXES:
        out.update([w[:n] + "*" for w in clean if len(w) > n])
    if "!!" in text:
        out.add(" exclaims")
    if text.isupper():
        out.add(" shouts")
    return out


def term_rows(texts: DataFrame, known: frozenset[str] | None, columns: str) -> DataFrame:
    """(key, label, text) to (key, label, terms), those in ``known`` only if given."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column(2)]
            if known is not None:
                found = [f & known for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([sorted(f) for f in found], pa.list_(pa.string()))],
                ["key", "label", "terms"])

    return texts.mapInArrow(work, columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, training: Column, rows: int) -> DataFrame:
    """(key, label, text): at most ``rows`` labelled texts of each label, those
    with the smallest hash of their id, also where one id has many texts."""
    spark = docs.sparkSession
    marked = labels.where(training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("toxic").cast("int").alias("label"),
        F.xxhash64("doc_id").alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))
    chosen = marked.withColumn("r", rank).where(F.col("r") <= rows).select("doc_id", "label")
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)  # 2 * rows rows at most
    met = docs.join(F.broadcast(chosen), "doc_id").select(
        F.xxhash64("text").alias("key"), "label", F.xxhash64("doc_id").alias("h"),
        whole_text().alias("text")).groupBy("key", "label").agg(
            F.min("h").alias("h"), F.min("text").alias("text"))
    # Texts of one id come along with it, so the bound is drawn once more, over texts.
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h", "key"))
    return met.withColumn("r", nth).where(F.col("r") <= rows).select("key", "label", "text")


def candidates(sample: DataFrame, sizes: dict[int, int]) -> list[str]:
    """At most ``CANDIDATES`` terms that speak for toxic, by log odds times support."""
    counted = (
        term_rows(sample, None, "key bigint, label int, terms array<string>")
        .select("label", F.explode("terms").alias("term"))
        .groupBy("term").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    )
    odds = F.log((F.col("bad") + 0.5) / (sizes[1] + 1)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1))
    value = F.col("odds") * F.sqrt(F.col("bad"))
    ranked = counted.where(F.col("bad") >= 3).withColumn("odds", odds).where(F.col("odds") > 1.0)
    return [r["term"] for r in ranked.orderBy(value.desc(), "term").limit(CANDIDATES).collect()]


def choose(x: np.ndarray, toxic: np.ndarray, n_voters: int) -> list[int]:
    """Voters among the candidate columns, in two halves: first those that each
    add most toxic rows not spoken for yet (against clean rows they speak on),
    then the strongest others that no single chosen voter almost contains."""
    bad, good = x[toxic], x[~toxic]
    wrong = good.sum(axis=0) * (len(bad) / max(len(good), 1))
    open_rows = np.ones(len(bad), dtype=bool)
    chosen: list[int] = []
    while len(chosen) < n_voters // 2:
        gain = bad[open_rows].sum(axis=0) - 4.0 * wrong
        best = int(gain.argmax()) if len(gain) else -1
        if best < 0 or gain[best] < 1.5:
            break
        chosen.append(best)
        open_rows &= bad[:, best] == 0
    for i in np.flatnonzero(wrong <= 0.02 * bad.sum(axis=0)).tolist():
        if len(chosen) == n_voters:
            break
        shared = bad[:, i] @ bad[:, chosen]
        if not chosen or shared.max() < 0.9 * bad[:, i].sum():
            chosen.append(i)
    return chosen


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> np.ndarray:
    """Posterior of the toxic class from 0/1 votes; a silent voter abstains.

    One more voter is added that votes clean where all others are silent.  EM
    estimates for every voter how often it is right when it speaks (starting
    from the belief of four in five), and the correlations of voters within the
    classes: a voter's evidence is divided by the sum of its positive
    correlations, so voters that say the same thing together count once.
    """
    n = len(votes)
    silent = (votes.sum(axis=1) == 0).astype(float)
    posterior = np.where(silent > 0, 0.1, 0.9)
    base = np.log(prior / (1 - prior))
    for _ in range(rounds):
        spoken = votes.sum(axis=0)
        right = (posterior @ votes + 4.0) / (spoken + 5.0)
        clean = ((1 - posterior) @ silent + 4.0) / (silent.sum() + 5.0)
        weight = max(posterior.sum(), 1e-9)
        up = posterior @ votes / weight
        down = (1 - posterior) @ votes / max(n - weight, 1e-9)
        residual = votes - np.outer(posterior, up) - np.outer(1 - posterior, down)
        spread = np.sqrt((residual * residual).sum(axis=0)) + 1e-9
        together = (residual.T @ residual) / np.outer(spread, spread)
        np.fill_diagonal(together, 1.0)
        divide = np.where(together > 0.1, together, 0.0).sum(axis=0)
        evidence = (np.log(right / (1 - right)) - base) / divide
        against = np.log(clean / (1 - clean)) + base
        z = base + votes @ evidence - silent * against
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - posterior).max() < 1e-4:
            return new
        posterior = new
    return posterior


def linear(x: np.ndarray, target: np.ndarray, penalty: float = 1e-4,
           steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    n, m = x.shape
    weight = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6))
    w, b = np.zeros(m), 0.0
    vw, vb = w.copy(), b
    rate = 4.0 / max(1.0, float((x * x).sum(axis=1).max()) ** 0.5)
    for t in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30))) - target)
        nw, nb = vw - rate * (x.T @ error / n + penalty * vw), vb - rate * error.mean()
        momentum = t / (t + 3)
        vw, vb = nw + momentum * (nw - w), nb + momentum * (nb - b)
        w, b = nw, nb
    return w, b


def calibrate(z: np.ndarray, toxic: np.ndarray, threshold: float) -> float:
    """What to add to the classifier's sums so that the threshold score falls on
    the cut that serves the labelled sample best, a wrong alarm costing twenty
    times a miss (in rates); of equal cuts the middle of the widest gap."""
    order = np.argsort(z, kind="stable")
    missed = np.append(0, np.cumsum(toxic[order])) / max(toxic.sum(), 1)
    alarms = np.append(0, np.cumsum(~toxic[order]))
    alarms = (alarms[-1] - alarms) / max((~toxic).sum(), 1)
    edges = np.concatenate([[z.min() - 2], z[order], [z.max() + 2]])
    gaps = np.diff(edges)
    loss = np.where(gaps > 0, missed + 20 * alarms, np.inf)
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    at = best[gaps[best].argmax()]
    return float(np.log(threshold / (1 - threshold)) - (edges[at] + edges[at + 1]) / 2)


def score_toxicity(docs: DataFrame, labels: DataFrame, training: Column, threshold: float = 0.7,
                   sample_rows: int = 3000, n_voters: int = 80, n_terms: int = 300) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``.

    Learns from at most ``sample_rows`` texts of each label (toxic 0 / 1;
    null labels and ids are left out) for which ``training`` holds.  With one
    label or none, or without any telling term, every score is the share of
    label 1 (0 without labels).  Null texts count as empty, whole texts are read
    however long, equal texts have equal scores; repeated rows and ids keep their
    rows, an empty table gives none; only doc_id and text are read of the
    documents, whatever other columns there are.
    """
    sample = labelled_sample(docs, labels, training, sample_rows).cache()
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    weights: dict[str, float] = {}
    bias, flat = 0.0, sizes.get(1, 0) / total if total else 0.0
    if sizes.get(0) and sizes.get(1):
        vocabulary = candidates(sample, sizes)
        if vocabulary:
            place = {t: i for i, t in enumerate(vocabulary)}
            rows = term_rows(sample, frozenset(vocabulary),
                             "key bigint, label int, terms array<string>").orderBy(
                                 "key", "label").collect()
            x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
            for i, row in enumerate(rows):  # the bounded sample
                x[i, [place[t] for t in row["terms"]]] = 1.0
            toxic = np.array([row["label"] == 1 for row in rows])
            voters = choose(x, toxic, n_voters)
            posterior = label_model(x[:, voters].astype(float), flat)
            used = voters + [i for i in range(min(n_terms, len(vocabulary))) if i not in set(voters)]
            w, bias = linear(x[:, used].astype(float), posterior)
            bias += calibrate(x[:, used] @ w + bias, toxic, threshold)
            weights = {vocabulary[i]: float(v) for i, v in zip(used, w)}
            flat = None
    sample.unpersist()
    known = frozenset(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if flat is not None:
                scores = np.full(batch.num_rows, flat)
            else:
                z = np.array([bias + sum(weights[t] for t in sorted(terms(text.as_py()) & known))
                              for text in batch.column(1)], dtype=float)
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], ["row_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("row_id"), whole_text().alias("text"))
    return rows.mapInArrow(work, "row_id bigint, score double").select(
        F.col("row_id").alias("doc_id"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
