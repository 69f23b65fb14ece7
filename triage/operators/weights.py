"""Class weights from the table of category counts ``(category, n)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage.operators.profile import whole


def _balanced() -> Column:
    classes = F.count(F.lit(1)).over(whole())
    return F.bround(F.sum("n").over(whole()) / (classes * F.col("n")), 4)


def imbalance(counts: DataFrame) -> DataFrame:
    """Count, share, balanced weight and the largest-to-smallest ratio."""
    return counts.select(
        "category",
        "n",
        F.bround(F.col("n") / F.sum("n").over(whole()), 4).alias("share"),
        _balanced().alias("balanced_w"),
        (F.max("n").over(whole()) / F.min("n").over(whole())).alias("imbalance_ratio"),
    )


def class_weights(
    counts: DataFrame,
    *,
    cap: float = fv.WEIGHT_CAP,
    betas: Sequence[tuple[str, float]] = fv.EFFECTIVE_BETAS,
) -> DataFrame:
    """Balanced, capped and effective-number weights, four decimals each."""
    effective = {}
    for name, beta in betas:
        inverse = (1.0 - beta) / (1.0 - F.pow(F.lit(beta), F.col("n").cast("double")))
        effective[name] = F.bround(inverse / F.avg(inverse).over(whole()), 4)
    return counts.select(
        "category",
        "n",
        _balanced().alias("balanced"),
        F.least(_balanced(), F.lit(float(cap))).alias("capped"),
        *[c.alias(name) for name, c in effective.items()],
    )


def effective_distribution(weights: DataFrame) -> DataFrame:
    """Share of weight × count per scheme and category; ``raw`` is unweighted."""
    schemes = [c for c in weights.columns if c not in ("category", "n")]
    cells = F.array(
        F.struct(F.lit("raw").alias("scheme"), F.lit(1.0).alias("w")),
        *[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("w")) for s in schemes],
    )
    long = weights.select("category", "n", F.inline(cells))
    mass = F.col("w") * F.col("n")
    return long.select(
        "scheme",
        "category",
        F.bround(mass / F.sum(mass).over(Window.partitionBy("scheme")), 4).alias("share"),
    )


def with_class_weight(df: DataFrame, weights: DataFrame, scheme: str = "balanced") -> DataFrame:
    """Each row with its category's weight; the weight table has one row per class."""
    column = weights.select("category", F.col(scheme).alias("weight"))
    return df.join(column, "category", "left")
