from __future__ import annotations

import pytest

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def shaped(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], DOCS)


@pytest.fixture(scope="session")
def long_text():
    return "word one two three four. " * 20_000 + "x" * 300_000 + "1" * 100_000


@pytest.fixture
def odd(spark, long_text):
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties, and extra columns with likely names."""
    same = "The same words stand here in this document again and again today."
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, same, "b"), (4, same, "b"), (5, same, "b"), (5, "Another text for the same id, mail me at x.y@ex.com now.", "b"), (6, long_text, "a"), (None, "No id here, call +1 234 567 8901 please.", None), (7, "one", "c"), (8, "日本語 テキスト ñandú 🙂 <|endoftext|> done", "c")]
    df = shaped(spark, rows)
    for name in ("row", "n", "rate", "salt", "table", "source_key", "kind", "component_id", "slice", "bucket", "ahead", "near", "copies", "_row", "_more", "more"):
        df = df.withColumn(name, df["lang"])
    return df


@pytest.fixture
def none(spark):
    return shaped(spark, [])
