"""Compare registered queries with their SQL in DuckDB, value by value.

``python tests/compare.py [--sf 0.01] [name …]`` prints one line per query.
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(v):
    """A comparable form: numbers as floats rounded to 9 digits, nested values as tuples."""
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float) and math.isnan(v):
        return ("nan",)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return ("map", tuple(sorted((k, normal(x)) for k, x in v.items())))
    if isinstance(v, (list, tuple)):
        return ("list", tuple(normal(x) for x in v))
    if isinstance(v, str):
        return ("str", v)
    try:
        return ("num", round(float(v), 9) + 0.0)
    except (TypeError, ValueError):
        return ("other", str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, run, sql, sf_dir):
    """(ok, message) of one query."""
    df = run(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return bool(left), f"{len(left)} rows, no SQL"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    right = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} / {sorted(cols)}"
    if len(left) != len(right):
        return False, f"rows {len(left)} / {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(left)} rows differ, e.g. {str(bad[0])[:600]}"
    return True, f"{len(left)} rows equal"


def main() -> int:
    sys.path.insert(0, str(ROOT))
    from queries.registry import REGISTRY

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = session(), duck(sf_dir)
    failures = 0
    for name in args.names or REGISTRY:
        run, sql = REGISTRY[name]
        start = time.time()
        try:
            ok, message = compare(spark, con, run, sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{type(e).__name__}: {str(e)[:900]}"
        failures += not ok
        print(f"{'ok ' if ok else 'BAD'} {name}: {message} [{time.time() - start:.1f}s]", flush=True)
    print(f"{failures} failed")
    return failures


if __name__ == "__main__":
    sys.exit(main())
