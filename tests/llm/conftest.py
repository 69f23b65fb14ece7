import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text[, lang, source]) rows."""

    def make(rows, extra=False):
        full = [(*r, *(None, None, None)[len(r) - 2 :]) for r in rows]
        full = [(i, t, lang, source, len(t or "")) for i, t, lang, source, *_ in full]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("score", "fp", "key", "th", "line", "block", "token", "words", "label", "tokens", "_th"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) + str(i % 977) for i in range(30_000))
    return [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
        (2, "one two three four five six seven eight nine ten eleven", "en", "a"),
        (2, "one two three four five six seven eight nine ten eleven", "en", "a"),
        (3, "", "en", "a"),
        (4, None, "en", None),
        (None, "un deux trois quatre cinq six sept huit neuf dix onze", None, "b"),
        (5, long, "en", "b"),
        (6, "  \n\n \t ", "de", "b"),
        (7, "12 34 éß \U0001f600 你好", "fr", "c"),
    ]


@pytest.fixture
def no_python():
    def check(df):
        import re

        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), plan
        assert "CartesianProduct" not in plan

    return check
