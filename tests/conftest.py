import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from compare import session

    return session()


@pytest.fixture
def texts(spark):
    """A one-column table of texts with their place as id."""

    def make(values):
        rows = list(enumerate(values))
        return spark.createDataFrame(rows, "ticket_id long, text string")

    return make


@pytest.fixture
def apply(texts):
    """Values of a column expression over ``text``, in input order."""

    def run(function, values):
        rows = texts(values).select("ticket_id", function("text").alias("out")).collect()
        return [r["out"] for r in sorted(rows, key=lambda r: r["ticket_id"])]

    return run
