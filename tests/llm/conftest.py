import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (id, text) pairs, with extra columns whose names clash with results."""

    def make(rows, clash=False):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F

            for name in ("kept", "fp", "score", "h", "n_words", "component_id", "keep_id", "id", "t", "__in", "sequence_id", "lang_pred"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, white space, ties, repeats and a long text."""
    r = random.Random(5)
    words = [f"w{r.randrange(300)}" for _ in range(30_000)]
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One  TWO"), (7, "one two\n"), (8, " ".join(words)),
        (9, " ".join(words)), (10, "ä ö ü ß"), (10, "ä ö ü ß"), (None, "no id"), (11, "１２３ !!"), (12, "▁a  b   c"),
    ]
