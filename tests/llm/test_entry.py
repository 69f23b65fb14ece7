"""Registration, the SQL of queries that have one, and the import guard."""

import json
import os
import re
import shutil
import subprocess
import sys

import pytest

import compare
from triage.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, name):
    ok, message = compare.compare(spark, compare.duck(SF), QUERIES[name], SQL[name], SF)
    assert ok, message


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES]
    assert sorted(numbers) == list(range(1, 14))


def test_entry_works_without_the_subpackage(tmp_path):
    for part in ("triage", "queries", "__spark_entry__.py", "corpus_pipeline.py"):
        source = compare.ROOT / part
        ignore = shutil.ignore_patterns("__pycache__")
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=ignore)
        else:
            shutil.copy(source, tmp_path / part)
    code = (
        "import json, sys, __spark_entry__ as e; print('NAMES' + json.dumps([sorted(e.queries()), "
        "[m.__file__ for n, m in sys.modules.items() if n.split('.')[0] in ('triage', 'queries', 'corpus_pipeline')]]))"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # which may name the repository itself

    def names():
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=env)
        found, files = json.loads(out.stdout.split("NAMES")[1])
        assert all(f.startswith(str(tmp_path)) for f in files)
        return set(found)

    whole = names()
    assert set(QUERIES) | {"pipeline"} <= whole
    (tmp_path / "corpus_pipeline.py").unlink()
    assert whole - names() == {"pipeline"}
    shutil.rmtree(tmp_path / "triage" / "llm")
    assert whole - names() == {"pipeline", *QUERIES}


def test_nothing_else_imports_the_subpackage():
    for top in ("triage", "queries"):
        for path in (compare.ROOT / top).rglob("*.py"):
            if "llm" not in path.parts:
                assert "llm" not in path.read_text(), path
