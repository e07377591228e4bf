import pytest

LONG = "lorem ipsum " * 30_000  # 360,000 characters


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and
    columns whose names the operators use themselves."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en"),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en"),
        (3, None, "en"), (4, "", None), (None, "a row without an id", "en"),
        (5, LONG, "de"), (6, "  \n\t ", "fr"), (7, "12 34 !? --", None),
        (8, "ÄÖÜ ß é́ \U0001f600 <|endoftext|> don't", "de"),
        (8, "ÄÖÜ ß é́ \U0001f600 <|endoftext|> don't", "de"),
        (9, "short", "en"), (9, "another text under one id", "en"), (10, None, None),
    ]
    wide = [r + (None, "x", 0.5, 1, "c", True) for r in rows]
    return spark.createDataFrame(
        wide, "doc_id bigint, text string, lang string, source string, row string, "
              "score double, n long, class string, extra boolean").repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, q, t) for i, (q, t) in enumerate([(1, 0), (0, 0), (1, 1), (None, None), (1, 1)] * 3)]
    return spark.createDataFrame([*rows, (None, 1, 1), (1, 1, 0)],
                                 "doc_id bigint, quality int, toxic int")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
