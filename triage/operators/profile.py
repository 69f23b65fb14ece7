"""Counts, distributions and text statistics.

Statistics of lengths and word counts start from a count per distinct value. That
shuffle carries one row per distinct value and map task, spreads over all reducers
and has no hot key; the exact percentiles then read the small count table. Distinct
lengths are few: k of them need at least k*k/2 characters of text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage.functions import text as tx
from triage.functions.binding import column
from triage.operators.columns import require_columns


def dimension(spark: SparkSession, values: Sequence[str], name: str, number: str) -> DataFrame:
    """One row per declared value, numbered in declared order."""
    literal = F.array(*[F.lit(v) for v in values])
    return spark.range(1).select(F.posexplode(literal).alias(number, name))


def whole() -> Window:
    """Window over all rows, for tables that hold one row per class or bucket."""
    return Window.partitionBy(F.lit(0))


def category_distribution(df: DataFrame, by: str = "category") -> DataFrame:
    """Tickets per category, most frequent first; nulls are not counted."""
    return (
        df.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), by)
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every value of several columns in one pass: ``(column, value, n)``."""
    sets = [[F.col(c)] for c in columns]
    counted = df.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_off_{c}") for c in columns]
    )
    which = F.coalesce(*[F.when(F.col(f"_off_{c}") == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.col(c).cast("string") for c in columns])
    return counted.select(which.alias("column_name"), value.alias("value"), "n").where(
        F.col("value").isNotNull()
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Row count, non-null count and type of each column, from one aggregation."""
    fields = df.schema.fields
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)],
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("n_rows"),
            F.col(f"c{i}").alias("non_null"),
        )
        for i, f in enumerate(fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def counts_per_value(df: DataFrame, value: Column, *groups: str) -> DataFrame:
    """``(groups…, v, n)``: how often each value occurs; null values are left out."""
    return (
        df.select(*groups, value.alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy(*groups, "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _percentile(*points: float) -> Column:
    return F.percentile(F.col("v"), [float(p) for p in points], F.col("n"))


def _mean() -> Column:
    return F.sum(F.col("v") * F.col("n")) / F.sum("n")


def _stddev() -> Column:
    """Sample deviation from exact integer sums; null for a single row."""
    big = "decimal(19,0)"
    v, n = F.col("v").cast(big), F.col("n").cast(big)
    size = F.sum("n").cast("double")
    total = F.sum(v * n).cast("double")
    squares = F.sum((v * v).cast("decimal(24,0)") * n.cast("decimal(13,0)")).cast("double")
    spread = F.greatest(squares - total * total / size, F.lit(0.0))
    return F.when(size > 1, F.sqrt(F.try_divide(spread, size - 1)))


def describe_length(
    df: DataFrame, text: Column | str = "body", *, approx: bool = False
) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of the text length.

    ``approx`` swaps the exact percentiles for ``percentile_approx`` over the rows.
    """
    length = F.length(column(text)).cast("long")
    if approx:
        v = length
        stats = df.agg(
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.percentile_approx(v, [0.25, 0.5, 0.75]).alias("q"),
            F.max(v).alias("max"),
        )
    else:
        stats = counts_per_value(df, length).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            _mean().alias("mean"),
            _stddev().alias("std"),
            F.min("v").alias("min"),
            _percentile(0.25, 0.5, 0.75).alias("q"),
            F.max("v").alias("max"),
        )
    quartiles = [F.get("q", F.lit(i)).alias(a) for i, a in enumerate(("p25", "p50", "p75"))]
    return stats.select("n", "mean", "std", "min", *quartiles, "max")


def length_histogram(
    df: DataFrame, text: Column | str = "body", bins: int = fv.HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width bins between the shortest and the longest text, last bin closed."""
    counts = counts_per_value(df, F.length(column(text)).cast("long"))
    ends = counts.select(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    placed = counts.withColumn("_ends", ends).select(
        F.col("_ends.lo").cast("double").alias("lo"),
        F.col("_ends.hi").cast("double").alias("hi"),
        F.col("v").cast("double").alias("v"),
        "n",
    )
    bucket = F.when(F.col("lo") == F.col("hi"), F.lit(1).cast("long")).otherwise(
        F.least(F.width_bucket("v", "lo", "hi", F.lit(bins)), F.lit(bins).cast("long"))
    )
    filled = (
        placed.withColumn("bin", bucket)
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
        .join(df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin"), "bin", "right")
    )
    width = (F.col("_ends.hi") - F.col("_ends.lo")) / F.lit(float(bins))
    return (
        filled.withColumn("_ends", ends)
        .select(
            "bin",
            (F.col("_ends.lo") + (F.col("bin") - 1) * width).alias("bin_from"),
            (F.col("_ends.lo") + F.col("bin") * width).alias("bin_to"),
            F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        )
    )


def boxplot(df: DataFrame, by: str, value: Column) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and outlier count per group."""
    counts = counts_per_value(df.where(F.col(by).isNotNull()), value, by)
    quartiles = (
        counts.groupBy(by)
        .agg(_percentile(0.25, 0.5, 0.75).alias("q"))
        .select(
            by,
            *[F.get("q", F.lit(i)).alias(a) for i, a in enumerate(("q1", "median", "q3"))],
        )
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        counts.join(quartiles, by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.sum("n").alias("n"),
            F.least(F.min(F.when(inside, F.col("v"))).cast("double"), "q1").alias("whisker_low"),
            F.greatest(F.max(F.when(inside, F.col("v"))).cast("double"), "q3").alias(
                "whisker_high"
            ),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).cast("long").alias("outliers"),
        )
        .select(by, "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
    )


def order_by_median(df: DataFrame, by: str = "category", text: str = "text") -> DataFrame:
    """Groups from the lowest to the highest median word count."""
    counts = counts_per_value(df.where(F.col(by).isNotNull()), tx.word_count(text), by)
    return (
        counts.groupBy(by)
        .agg(F.get(_percentile(0.5), F.lit(0)).alias("median_words"))
        .orderBy("median_words", by)
    )


def text_stats(df: DataFrame, by: str = "category", text: str = "text") -> DataFrame:
    """Tickets and mean, median and 95th percentile of words per group, one decimal."""
    counts = counts_per_value(df.where(F.col(by).isNotNull()), tx.word_count(text), by)
    stats = counts.groupBy(by).agg(
        F.sum("n").alias("n"), _mean().alias("mean"), _percentile(0.5, 0.95).alias("q")
    )
    return stats.select(
        by,
        "n",
        F.bround("mean", 1).alias("mean_words"),
        F.bround(F.get("q", F.lit(0)), 1).alias("median_words"),
        F.bround(F.get("q", F.lit(1)), 1).alias("p95_words"),
    )


def top_words(df: DataFrame, by: str = "type", text: str = "body", n: int = 15) -> DataFrame:
    """The ``n`` most frequent lower-case ASCII words of three letters or more per group.

    Words are counted before they are ranked, so the window sees each group's
    vocabulary, not its rows; ties are broken by the word.
    """
    counted = (
        df.select(by, F.explode(F.split(F.lower(F.col(text)), tx.NON_WORD)).alias("word"))
        .where(F.col("word").rlike("^[a-z]{3,}$"))
        .groupBy(by, "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(by).orderBy(F.desc("n"), "word")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()


def crosstab(
    df: DataFrame, rows: str, columns: str, column_values: Sequence[str], first: int = 10
) -> DataFrame:
    """Counts of ``rows`` × ``columns``, the ``first`` rows in name order, gaps as 0."""
    return (
        df.where(F.col(rows).isNotNull() & F.col(columns).isin(*column_values))
        .groupBy(rows)
        .pivot(columns, list(column_values))
        .count()
        .na.fill(0)
        .orderBy(rows)
        .limit(first)
    )


def distribution_zero_filled(
    df: DataFrame, categories: Sequence[str] = fv.CATEGORIES
) -> DataFrame:
    """Count of every declared category, 0 where none occurs."""
    dim = dimension(df.sparkSession, categories, "category", "cat_no")
    counts = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "category", "left").select(
        "cat_no", "category", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def split_comparison(df: DataFrame, categories: Sequence[str] = fv.CATEGORIES) -> DataFrame:
    """Overall, train, val and test counts per category, and the overall share."""
    require_columns(df, ("category", "split"))
    dim = dimension(df.sparkSession, categories, "category", "cat_no")
    names = ("train", "val", "test")
    counts = df.groupBy("category").agg(
        F.count(F.lit(1)).alias("overall"),
        *[F.count_if(F.col("split") == s).alias(s) for s in names],
    )
    filled = dim.join(counts, "category", "left").select(
        "cat_no",
        "category",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("overall", *names)],
    )
    share = F.try_divide(F.col("overall"), F.sum("overall").over(whole()))
    return filled.withColumn("share_overall", share)


def split_drift(
    df: DataFrame, categories: Sequence[str] = fv.CATEGORIES, limit: float = fv.DRIFT_LIMIT
) -> DataFrame:
    """Largest gap between a category's share in a split and its overall share."""
    gaps = split_comparison(df, categories).select(
        *[
            F.abs(F.try_divide(F.col(s), F.sum(s).over(whole())) - F.col("share_overall")).alias(s)
            for s in ("train", "val", "test")
        ]
    )
    worst = gaps.agg(F.max(F.greatest("train", "val", "test")).alias("max_deviation"))
    return worst.withColumn("passed", F.col("max_deviation") < limit)


def majority_baseline(counts: DataFrame) -> DataFrame:
    """Accuracy of always answering the most frequent category."""
    return counts.agg((F.max("n") / F.sum("n")).alias("majority_accuracy"))


def prepare_summary(df: DataFrame) -> DataFrame:
    """Sizes and category counts overall and per split, from one aggregation.

    ``category`` is null in the rows that hold a scope's size.
    """
    require_columns(df, ("category", "split"))
    cells = df.groupBy("split", "category").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.lit("all"), F.col("split"))
    scoped = cells.select(F.explode(both).alias("scope"), "category", "n")
    return scoped.groupingSets(
        [[F.col("scope"), F.col("category")], [F.col("scope")]],
        F.col("scope"),
        F.col("category"),
    ).agg(F.sum("n").alias("n"))
