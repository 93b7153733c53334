import pytest

#: Nulls, empty and blank texts, repeats, ties, long texts, extra columns whose names clash with the operators' own.
ROWS = [
    (1, "the quick brown fox\njumps over the lazy dog", "en", "s"),
    (2, None, None, None),
    (3, "", "en", "s"),
    (4, "   \n\t ", "de", "t"),
    (5, "the quick brown fox\njumps over the lazy dog", "en", "s"),
    (5, "the quick brown fox\njumps over the lazy dog", "en", "s"),
    (6, "word " * 30_000, "en", "s"),
    (7, "é ▁ \x00 \r\n 🙂 中文 <s> </s>", "fr", "u"),
    (None, "no id here", "en", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("score", "n_words", "fp", "label", "media", "hits", "n_chars", "gid", "pos", "m", "a", "b", "component_id", "least", "items", "spans")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
