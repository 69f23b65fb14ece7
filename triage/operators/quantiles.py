"""Quantiles of values that hardly repeat, from mergeable sketches.

The exact percentiles of ``operators.profile`` start from a count per distinct value, a table as
large as the data when every value is another. A KLL sketch of a group has a fixed size however many
rows it has seen: tasks sketch their rows, sketches are merged before and after the shuffle, and
tables of sketches (one a day, say) can be kept and merged later without the rows.

A quantile's rank is off by at most ``rank_error(k)`` of the rows, at 99% confidence for each
quantile asked for; up to ``k`` values a sketch is exact. Minimum, maximum and count are exact, and
so are a box plot's whiskers and outliers for the fences that the sketched quartiles give.

Nulls and NaN are left out; a group without values has no row. Quantiles are values that occur,
not interpolated ones: the least value at or below which there is at least that share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of the sketches: some 0.1% of the rows.
K = 3000
#: Fixed values of the sketch's published error bound, for one quantile at a time.
ERROR_SCALE, ERROR_POWER = 2.296, 0.9723


def rank_error(k: int = K) -> float:
    """The share of the rows by which a quantile's rank is off at most, at 99% confidence."""
    return ERROR_SCALE / k**ERROR_POWER


def sketch(df: DataFrame, value: Column, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """(…by, n, min, max, sketch): one mergeable row for each group."""
    v = value.cast("double")
    rows = df.select(*by, F.when(~F.isnan(v), v).alias("v")).where("v is not null")
    return _filled(
        rows.groupBy(*by).agg(
            F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.kll_sketch_agg_double("v", k).alias("sketch")
        )
    )


def merge(sketches: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """Sketches of parts, by coarser groups or the same, as one for each group."""
    return _filled(
        sketches.groupBy(*by).agg(
            F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", k).alias("sketch")
        )
    )


def _filled(table: DataFrame) -> DataFrame:
    """Without the row that an aggregate without groups gives of nothing."""
    return table.where("n > 0")


def quantiles(sketches: DataFrame, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(…by, n, min, max, q): the quantiles at ``points``, in their order."""
    return sketches.select(*by, "n", "min", "max", _at(points).alias("q"))


def _at(points: Sequence[float]) -> Column:
    return F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in points))


def describe(df: DataFrame, value: Column, k: int = K) -> DataFrame:
    """n, mean, std, min, p25, p50, p75 and max as ``describe_length``, in one pass of fixed state."""
    v = value.cast("double")
    rows = df.select(F.when(~F.isnan(v), v).alias("v")).where("v is not null")
    stats = rows.agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.kll_sketch_agg_double("v", k).alias("sketch"),
    )
    own = stats.select("n", "mean", "std", "min", "max", F.when(F.col("n") > 0, _at((0.25, 0.5, 0.75))).alias("q"))
    quartiles = [F.get("q", F.lit(i)).alias(a) for i, a in enumerate(("p25", "p50", "p75"))]
    return own.select("n", "mean", "std", "min", *quartiles, "max")


def boxplot(df: DataFrame, by: str, value: Column, k: int = K) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and outliers per group, as ``profile.boxplot``.

    A second pass compares the rows with their group's fences, one row per group.
    """
    v = value.cast("double")
    rows = df.where(F.col(by).isNotNull()).select(by, F.when(~F.isnan(v), v).alias("v")).where("v is not null")
    found = quantiles(sketch(rows, F.col("v"), [by], k), (0.25, 0.5, 0.75), [by])
    q = [F.get("q", F.lit(i)) for i in range(3)]
    reach = 1.5 * (q[2] - q[0])
    fences = found.select(
        by, *(x.alias(a) for x, a in zip(q, ("q1", "median", "q3"), strict=True)), (q[0] - reach).alias("_low"), (q[2] + reach).alias("_high")
    )
    inside = F.col("v").between(F.col("_low"), F.col("_high"))
    return (
        rows.join(fences, by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.count("v").alias("n"),
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
        .select(by, "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
    )


def rank_errors(
    df: DataFrame,
    value: Column,
    points: Sequence[float],
    by: Sequence[str] = (),
    k: int = K,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """(…by, point, quantile, n, error): how far each sketched quantile's true rank is from its point, as a share.

    Of ``sketches`` if given, else of one pass over the rows. Measured against all rows: those below and those at or below the quantile bound the ranks it may have.
    """
    v = value.cast("double")
    rows = df.select(*by, F.when(~F.isnan(v), v).alias("v")).where("v is not null")
    own = sketch(rows, F.col("v"), by, k) if sketches is None else sketches
    found = quantiles(own, points, by).drop("n", "min", "max")
    counts = [x for i in range(len(points)) for x in (F.count_if(F.col("v") < F.get("q", F.lit(i))), F.count_if(F.col("v") <= F.get("q", F.lit(i))))]
    joined = rows.join(found, list(by)) if by else rows.crossJoin(F.broadcast(found))  # one row
    ranks = joined.groupBy(*by, "q").agg(F.count("v").alias("n"), F.array(*counts).alias("c"))
    each = F.array(
        *(
            F.struct(
                F.lit(float(p)).alias("point"),
                F.get("q", F.lit(i)).alias("quantile"),
                F.greatest(
                    F.lit(0.0), F.get("c", F.lit(2 * i)) / F.col("n") - p, p - F.get("c", F.lit(2 * i + 1)) / F.col("n")
                ).alias("error"),
            )
            for i, p in enumerate(points)
        )
    )
    return ranks.select(*by, "n", F.inline(each)).select(*by, "point", "quantile", "n", "error")
