"""Quality scores by Bradley-Terry ranking.

A document's strength is linear in features of its text.  Labelled pairs (a
good document is preferred to a poor one) give feature differences, and
logistic loss on the differences gives the weights.  The decision threshold is
the quantile of the labelled strengths that leaves the share of poor ones below.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillstream.llm.common import as_row, row_columns, stored, whole_text

PAIRS_PER_DOCUMENT = 8


def features(text: Column) -> Column:
    """Shape of a text as an array of doubles, all near 0 .. 3; empty texts count as all zero ratios."""
    n = F.greatest(F.char_length(text), F.lit(1))
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    n_words = F.greatest(F.size(words), F.lit(1))
    lines = F.split(text, "\n")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / n

    upper, symbols, digits = share(r"\p{Lu}"), share(r"[^\p{L}\p{N}\s.,]"), share(r"[0-9]")
    stops, commas, spaces = share(r"[.]"), share(r","), share(r"\s")
    distinct = F.size(F.array_distinct(words)) / n_words
    repeated_lines = 1 - F.size(F.array_distinct(lines)) / F.size(lines)
    ratios = [upper, symbols, digits, stops, commas, spaces, repeated_lines]
    bent = [F.log1p(F.lit(30.0) * r) for r in (upper, symbols, digits, stops, commas)]
    return F.array(
        *[r.cast("double") for r in ratios], *bent,
        distinct.cast("double"), (distinct * F.log1p(n_words) / 5).cast("double"),
        (F.log1p(n) / 5).cast("double"), (F.log1p(n_words) / 5).cast("double"),
        (F.least(n / n_words, F.lit(30.0)) / 10).cast("double"),
        (F.size(lines) / n_words).cast("double"),
    )


def preference_pairs(sample: DataFrame, per_document: int) -> DataFrame:
    """Differences (better minus worse, label 1, and the reverse, label 0).

    The sample's two sides are ranked by a hash; rank i of the larger side
    meets ranks i, i + s, i + 2s ... of the other side, so no side is paired
    whole with the other.
    """
    by_hash = Window.partitionBy("label").orderBy("h", "row_id")
    ranked = sample.withColumn("rank", F.row_number().over(by_hash) - 1)
    sides = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    more, less = (1, 0) if sides[1] >= sides[0] else (0, 1)
    step = max(1, sides[less] // per_document)
    many = ranked.where(F.col("label") == more).select(
        F.col("f").alias("fa"),
        F.explode(F.array_distinct(F.array(*(
            (F.col("rank") + F.lit(j * step)) % F.lit(sides[less]) for j in range(per_document)
        )))).alias("rank"),
    )
    few = ranked.where(F.col("label") == less).select("rank", F.col("f").alias("fb"))
    sign = 1.0 if more == 1 else -1.0
    difference = F.zip_with("fa", "fb", lambda a, b: (a - b) * F.lit(sign))
    pairs = many.join(few, "rank").select(difference.alias("d"))
    return pairs.select("d", F.lit(1.0).alias("label")).unionByName(
        pairs.select(F.transform("d", lambda x: -x).alias("d"), F.lit(0.0).alias("label")))


@dataclass(frozen=True)
class Ranking:
    """Weights of the features, and the strength at which the score is ``threshold``."""

    weights: tuple[float, ...]
    cut: float
    threshold: float

    def strength(self, f: Column) -> Column:
        weights = F.array(*(F.lit(w) for w in self.weights)).cast("array<double>")
        return F.aggregate(F.zip_with(f, weights, lambda x, w: x * w), F.lit(0.0),
                           lambda total, x: total + F.coalesce(x, F.lit(0.0)))

    def score(self, strength: Column) -> Column:
        shift = math.log(self.threshold / (1 - self.threshold)) - self.cut
        bounded = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), strength + F.lit(shift)))
        return 1 / (1 + F.exp(-bounded))


def fit_ranking(described: DataFrame, labels: DataFrame, training: Column, threshold: float = 0.3,
                sample_rows: int = 3000) -> Ranking:
    """Learn from rows (doc_id, f) with a label.

    ``labels`` has doc_id and quality (1 preferred to 0; null rows are left
    out); only rows for which ``training`` holds are learned from, at most
    ``sample_rows`` of each label, those with the smallest hash of their
    features.  The cut is the quantile, among all labelled strengths, at the
    share of label 0.  With one label or none there is nothing to rank: every
    strength is 0 and the score is the share of label 1 (0.5 without labels).
    """
    marked = labels.where(training & F.col("quality").isNotNull()).select(
        "doc_id", F.col("quality").cast("int").alias("label"))
    labelled = stored(
        described.select("doc_id", "f").join(marked, "doc_id").select(
            "label", "f", F.xxhash64("f").alias("h"), F.col("doc_id").alias("row_id")),
        "quality-labelled")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    shift = math.log(threshold / (1 - threshold))
    if not (counts.get(0) and counts.get(1)):
        share = min(max(counts.get(1, 0) / total if total else 0.5, 1e-6), 1 - 1e-6)
        return Ranking((), shift - math.log(share / (1 - share)), threshold)
    sample = stored(
        labelled.where("label = 1").orderBy("h", "row_id").limit(sample_rows).unionByName(
            labelled.where("label = 0").orderBy("h", "row_id").limit(sample_rows)),
        "quality-sample")
    pairs = preference_pairs(sample, PAIRS_PER_DOCUMENT)
    model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=60).fit(
        pairs.select(array_to_vector("d").alias("features"), "label"))
    ranking = Ranking(tuple(float(w) for w in model.coefficients), 0.0, threshold)
    share = counts[0] / total
    below, above = labelled.select(ranking.strength(F.col("f")).alias("s")).agg(
        F.percentile_approx("s", F.array(F.lit(max(0.0, share - 1 / total)),
                                         F.lit(min(1.0, share + 1 / total))), 100_000)
    ).first()[0]
    return Ranking(ranking.weights, (below + above) / 2, threshold)


def rank_quality(docs: DataFrame, labels: DataFrame, training: Column,
                 threshold: float = 0.3) -> DataFrame:
    """doc_id, score, strength, predicted for every row of ``docs``.

    Null texts count as empty, texts may be of any length, equal texts have equal
    scores; repeated rows and ids keep their rows; an empty table gives no rows;
    only doc_id and text are read, whatever other columns there are.
    """
    described = stored(
        docs.select("doc_id", features(whole_text()).alias("f")), "quality-features")
    ranking = fit_ranking(described, labels, training, threshold)
    strength = ranking.strength(F.col("f"))
    return described.select("doc_id", ranking.score(strength).alias("score"),
                            strength.alias("strength")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, training: Column,
              threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all columns.

    Each row is judged where it is read; texts are not moved.  Null texts count
    as empty, texts may be of any length, equal texts have equal scores, repeated
    rows stay rows, columns may have any names and hold nulls, and an empty table
    gives no rows.
    """
    ranking = fit_ranking(
        docs.select("doc_id", features(whole_text()).alias("f")), labels, training, threshold)
    # The features stay in a projection, which evaluates shared parts once; a
    # filter would repeat them.  The generator keeps the filter above it.
    described = docs.select(as_row(docs).alias("row"), features(whole_text()).alias("f"))
    judged = described.select("row", F.explode(F.array(ranking.strength(F.col("f")))).alias("strength"))
    return judged.where(ranking.score(F.col("strength")) >= threshold).select(*row_columns(docs, "row"))
