"""URL verdicts from host and path rules and, where none fits, boosted trees.

URLs that a rule decides are the labelled ones.  Gradient-boosted trees learn
from their lexical features (length, depth, digit ratio, entropy, parameter
counts, statistics of the host's suffix) and judge the rest.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host, a slash and the beginning of a path."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host):]


FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_host_labels", "f_depth", "f_digit_ratio",
    "f_symbol_ratio", "f_entropy", "f_parameters", "f_query_length", "f_fragment", "f_secure",
    "f_extension", "f_suffix_share", "f_domain_share",
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls; of equal rules the first."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.pattern).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character; each distinct character adds its share."""
    n = F.char_length(text)
    terms = F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0),
        lambda acc, c: acc + F.when(F.char_length(c) == 0, 0.0).otherwise(
            (n - F.char_length(F.replace(text, c, F.lit("")))) / n
            * F.log2(n / (n - F.char_length(F.replace(text, c, F.lit("")))))),
    )
    return F.when(n > 0, terms).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Feature columns from ``url``, ``host`` and ``path``; null urls count as empty."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        "f_length": F.char_length(url).cast("double"),
        "f_host_length": F.char_length("host").cast("double"),
        "f_path_length": F.char_length("path").cast("double"),
        "f_host_labels": F.regexp_count("host", F.lit(r"[^.]+")).cast("double"),
        "f_depth": F.regexp_count("path", F.lit(r"/[^/]+")).cast("double"),
        "f_digit_ratio": F.regexp_count(url, F.lit(r"[0-9]")) / n,
        "f_symbol_ratio": F.regexp_count(url, F.lit(r"[^0-9A-Za-z]")) / n,
        "f_entropy": entropy(url),
        "f_parameters": F.regexp_count(query, F.lit(r"[^&]+")).cast("double"),
        "f_query_length": F.char_length(query).cast("double"),
        "f_fragment": url.contains("#").cast("double"),
        "f_secure": F.coalesce(url.startswith("https"), F.lit(False)).cast("double"),
        "f_extension": F.coalesce(F.regexp_like("path", F.lit(r"\.[A-Za-z0-9]+$")),
                                  F.lit(False)).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
        "domain": F.substring_index("host", ".", -2),
    })


def shares(urls: DataFrame) -> DataFrame:
    """Suffix statistics over all urls: the logarithm of the share of rows with
    the host's last label, and with its last two."""
    total = urls.count()
    for key, name in (("suffix", "f_suffix_share"), ("domain", "f_domain_share")):
        # Reduced inside the tasks first, so a hot suffix is a row a task.
        counts = urls.groupBy(key).agg(F.log2(F.count("*") / F.lit(max(total, 1))).alias(name))
        urls = urls.join(counts, key)
    return urls


def judge(pages: DataFrame, rules: list[Rule], training_rows: int = 4000, trees: int = 20,
          depth: int = 4, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    ``score`` is the trees' probability of ``block`` (null where a rule
    decides).  They learn from at most ``training_rows`` labelled urls of each
    verdict, those with the smallest hash of the url, so repeated urls and row
    order do not matter.  A table without labelled urls allows the rest, with
    score 0; with one verdict only, the rest gets that verdict.  Null urls and
    urls without ``://`` have an empty host and path and are judged like any
    other; repeated rows stay rows; only page_id and url are read.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url").select(
        "page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    urls = shares(lexical(urls.withColumns({"rule": rule, "ruled": verdict})))

    sample = None
    for label, value in (("block", 1.0), ("allow", 0.0)):
        part = (
            urls.where(F.col("ruled") == label).select(F.lit(value).alias("label"), "url", *FEATURES)
            .dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(training_rows)
        )
        sample = part if sample is None else sample.unionByName(part)
    sample = stored(sample, "labelled-urls")
    labels = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(labels) == 2:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, featuresCol="features").fit(
            VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))
        scored = model.transform(
            VectorAssembler(inputCols=FEATURES, outputCol="features").transform(urls)
        ).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = urls.withColumn("score", F.lit(1.0 if labels == {1.0} else 0.0))
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("score"),
    )
