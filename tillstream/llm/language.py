"""Language by compression.

Each language has a raw-content zstandard dictionary made of lines of its own
documents.  A text is encoded once with each and the smallest encoding names
its language; where the best and the second are close, it is not accepted.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillstream.llm.common import whole_text

UNKNOWN = "und"
BLOCK = 4096
NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-cased words parted by single blanks; empty without letters."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    return words if any(map(str.isalpha, words)) else ""


def dictionaries(samples: list[tuple[str, str]], size: int) -> dict[str, bytes]:
    """Per language its lines in the given order, each once, without those that
    several languages share, up to ``size`` bytes; long lines are cut in parts."""
    owners: dict[str, set[str]] = defaultdict(set)
    lines: dict[str, dict[str, None]] = defaultdict(dict)
    for lang, text in samples:
        for line in text.split("\n"):
            words = plain(line).split(" ")
            for i in range(0, len(words), 60):
                if part := " ".join(words[i:i + 60]):
                    owners[part].add(lang)
                    lines[lang][part] = None
    out = {}
    for lang in sorted({lang for lang, _ in samples}):
        own = [part for part in lines[lang] if len(owners[part]) == 1] or list(lines[lang])
        raw = b""
        for part in own:
            if len(raw) >= size:
                break
            raw += part.encode() + b"\n"
        if len(raw) >= 8:  # zstandard's least
            out[lang] = raw[:size]
    return out


class Coder:
    """Compressed sizes of a text under every dictionary."""

    def __init__(self, contents: dict[str, bytes], level: int):
        import zstandard

        self.langs = list(contents)
        self.compressors = []
        for lang in self.langs:
            known = zstandard.ZstdCompressionDict(
                contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(
                level=level, dict_data=known, write_checksum=False, write_content_size=False,
                write_dict_id=False))

    def judge(self, text: str, min_margin: float) -> tuple[str, float, float, bool]:
        """Language, score, margin, accepted.  The margin is what the second
        best takes more, as a part of its size; of equal sizes the first
        language in alphabetical order wins."""
        words = plain(text).encode()
        if not words or not self.langs:
            return UNKNOWN, 0.0, 0.0, False
        sizes = [0] * len(self.langs)
        for at in range(0, len(words), BLOCK):
            block = words[at:at + BLOCK]
            for i, c in enumerate(self.compressors):
                sizes[i] += len(c.compress(block))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
        score = 1 / (1 + sum(math.exp(-min(50.0, (s - sizes[best]) / 4)) for s in rest))
        return self.langs[best], score, margin, margin >= min_margin


def training_texts(docs: DataFrame, training: Column, per_language: int) -> list[tuple[str, str]]:
    """At most ``per_language`` distinct texts of each language, those with the
    smallest hash, in hash order."""
    spark = docs.sparkSession
    hashed = docs.where(training & F.col("lang").isNotNull()).select(
        "lang", F.xxhash64(whole_text()).alias("h")).distinct()  # copies count once
    order = Window.partitionBy("lang").orderBy("h")
    chosen = hashed.withColumn("r", F.row_number().over(order)).where(
        F.col("r") <= per_language).select("lang", "h")
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)  # per_language rows a language
    rows = (
        docs.where(training).select("lang", whole_text().alias("text"))
        .withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"])
        .groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    )
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def identify(docs: DataFrame, training: Column, per_language: int = 150, dictionary_bytes: int = 1 << 16,
             level: int = 6, min_margin: float = 0.02) -> DataFrame:
    """doc_id, lang_pred, score, margin, accepted for every row.

    Learns from text and lang of the rows for which ``training`` holds; the
    sample is bounded by ``per_language`` and the dictionaries by
    ``dictionary_bytes``.  Null texts and texts without letters are ``und``
    with score 0; so is everything when there is no language to learn.
    ``accepted`` is false where the margin is narrow.  Repeated rows and ids
    keep their rows; whole texts are encoded, in blocks, however long.
    """
    contents = dictionaries(training_texts(docs, training, per_language), dictionary_bytes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(contents, level)
        for batch in batches:
            found = [coder.judge(t.as_py(), min_margin) for t in batch.column(1)]
            columns = list(zip(*found)) or [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["row_id", "lang_pred", "score", "margin", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("row_id"), whole_text().alias("text"))
    return rows.mapInArrow(
        work, "row_id bigint, lang_pred string, score double, margin double, accepted boolean"
    ).withColumnRenamed("row_id", "doc_id")
