import math
import random

import pytest
from pyspark.sql import functions as F

from triage.operators import quantiles as Q

POINTS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def rows(spark, n=60_000):
    rng = random.Random(3)
    make = {"flat": rng.random, "long tail": lambda: math.exp(4 * rng.gauss(0, 1)), "ties": lambda: rng.choice([1.0, 2.0, 7.0])}
    return spark.createDataFrame([(g, f()) for g, f in make.items() for _ in range(n // 3)], "g string, v double").repartition(7)


def test_ranks_are_within_the_stated_error(spark):
    found = Q.rank_errors(rows(spark), F.col("v"), POINTS, ["g"]).collect()
    assert len(found) == 3 * len(POINTS) and all(r["n"] == 20_000 for r in found)
    assert max(r["error"] for r in found) <= Q.rank_error()
    (one,) = {r["n"] for r in Q.rank_errors(rows(spark), F.col("v"), (0.5,)).collect()}
    assert one == 60_000


def test_merged_parts_are_as_good_as_the_whole(spark):
    df = rows(spark).withColumn("part", (F.rand(1) * 40).cast("int")).cache()
    parts = Q.sketch(df, F.col("v"), ["g", "part"])
    merged = Q.merge(parts, ["g"])
    whole = {r["g"]: r for r in Q.quantiles(Q.sketch(df, F.col("v"), ["g"]), POINTS, ["g"]).collect()}
    for r in Q.quantiles(merged, POINTS, ["g"]).collect():
        assert (r["n"], r["min"], r["max"]) == (whole[r["g"]]["n"], whole[r["g"]]["min"], whole[r["g"]]["max"])
        own = df.where(F.col("g") == r["g"])
        for p, q in zip(POINTS, r["q"]):
            low, high = own.agg(F.count_if(F.col("v") < q), F.count_if(F.col("v") <= q)).first()
            assert low / r["n"] - Q.rank_error() <= p <= high / r["n"] + Q.rank_error()


def test_a_sketch_does_not_grow_with_the_rows(spark):
    def size(n):
        return Q.sketch(spark.range(n), F.hash("id"), k=200).select(F.octet_length("sketch")).first()[0]

    assert size(400_000) < 1.6 * size(20_000) < 20_000


def test_few_values_are_exact(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,), (float("nan"),)], "v double")
    (r,) = Q.quantiles(Q.sketch(df, F.col("v")), (0.0, 0.25, 0.5, 1.0)).collect()
    assert (r["n"], r["min"], r["max"], r["q"]) == (100, 1.0, 100.0, [1.0, 25.0, 50.0, 100.0])
    d = Q.describe(df, F.col("v")).first()
    assert (d["n"], d["mean"], d["min"], d["p25"], d["p50"], d["p75"], d["max"]) == (100, 50.5, 1.0, 25.0, 50.0, 75.0, 100.0)


def test_boxplot(spark):
    values = [("a", float(v)) for v in [*range(1, 100), 1000, -900]] + [("b", 5.0), (None, 1.0), ("c", None)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in Q.boxplot(df, "g", F.col("v")).collect()}
    assert got["b"] == (1, 5.0, 5.0, 5.0, 5.0, 5.0, 0) and got.keys() == {"a", "b"}
    n, q1, median, q3, low, high, outliers = got["a"]
    assert (n, median, low, high, outliers) == (101, 50.0, 1.0, 99.0, 2) and abs(q1 - 25) <= 1 and abs(q3 - 75) <= 1


@pytest.mark.parametrize("by", [[], ["g"]])
def test_no_values_no_row(spark, by):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert Q.sketch(df, F.col("v"), by).count() == 0
    assert Q.merge(Q.sketch(df, F.col("v"), by), by).count() == 0
    assert Q.rank_errors(df, F.col("v"), (0.5,), by).count() == 0
    assert Q.describe(df, F.col("v")).first()["p50"] is None
