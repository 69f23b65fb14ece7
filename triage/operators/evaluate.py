"""Evaluation tables from predictions ``(ticket_id, split, y_true, y_pred, conf)``.

All metrics come from one count per (split, true, predicted); everything after that
aggregation works on at most labels² rows per split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage.operators.columns import require_columns

Labels = Sequence[str]
METRICS = ("precision", "recall", "f1")


def _labels(labels: Labels) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def _ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 where the bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top, bottom))


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """``(split, y_true, y_pred, n)``: the one shuffle over the predictions."""
    require_columns(predictions, ("split", "y_true", "y_pred"))
    return predictions.groupBy("split", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, labels: Labels = fv.CATEGORIES) -> DataFrame:
    """Rows of true labels, columns of predicted labels, zero-filled, per split."""
    rows = F.array(
        F.struct("y_true", "y_pred", "n"),
        *[
            F.struct(
                F.lit(x).alias("y_true"), F.lit(x).alias("y_pred"), F.lit(0).cast("long").alias("n")
            )
            for x in labels
        ],
    )
    return (
        counts.select("split", F.inline(rows))
        .where(F.col("y_true").isin(*labels))
        .groupBy("split", "y_true")
        .agg(
            *[
                F.sum(F.when(F.col("y_pred") == x, F.col("n")).otherwise(0))
                .cast("long")
                .alias(x)
                for x in labels
            ]
        )
    )


def _tallies(counts: DataFrame, labels: Labels) -> DataFrame:
    """``(split, label, support, predicted, hits)``; a null label stands for all rows.

    Each count is unfolded into what it adds to its true label, its predicted label and
    the total, and into a zero for every declared label, so all come from one reading.
    """
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")

    def part(label: Column, support: Column, predicted: Column, hits: Column) -> Column:
        return F.struct(
            label.cast("string").alias("label"),
            support.cast("long").alias("support"),
            predicted.cast("long").alias("predicted"),
            hits.cast("long").alias("hits"),
        )

    n = F.col("n")
    total = F.lit(None)
    parts = [
        part(F.when(F.col("y_true").isin(*labels), F.col("y_true")), n, zero, hit),
        part(F.when(F.col("y_pred").isin(*labels), F.col("y_pred")), zero, n, zero),
    ]
    # Labels outside the declared ones count towards the total only.
    known = F.filter(F.array(*parts), lambda x: x["label"].isNotNull())
    fixed = F.array(part(total, n, n, hit), *[part(F.lit(x), zero, zero, zero) for x in labels])
    return (
        counts.select("split", F.inline(F.concat(known, fixed)))
        .groupBy("split", "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )


def _rated(counts: DataFrame, labels: Labels) -> DataFrame:
    """Tallies with precision, recall and F1; in the null label these are the accuracy."""
    rated = _tallies(counts, labels).withColumns(
        {
            "precision": _ratio(F.col("hits"), F.col("predicted")),
            "recall": _ratio(F.col("hits"), F.col("support")),
        }
    )
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))


def metrics_per_class(counts: DataFrame, labels: Labels = fv.CATEGORIES) -> DataFrame:
    """Precision, recall, F1 and support per split and label; 0 on zero division."""
    rated = _rated(counts, labels).where(F.col("label").isNotNull())
    return rated.select("split", "label", "precision", "recall", "f1", "support")


def _per_split(counts: DataFrame, labels: Labels) -> DataFrame:
    """One row per split: accuracy, averages, size and the list of per-class metrics."""
    of_class = F.col("label").isNotNull()
    support = F.when(of_class, F.col("support"))
    means = []
    for c in METRICS:
        value = F.when(of_class, F.col(c))
        means.append(F.avg(value).alias(f"macro_{c}"))
        means.append(_ratio(F.sum(value * support), F.sum(support)).alias(f"weighted_{c}"))
    return (
        _rated(counts, labels)
        .groupBy("split")
        .agg(
            F.max(F.when(~of_class, F.col("recall"))).alias("accuracy"),
            F.max(F.when(~of_class, F.col("support"))).alias("n"),
            F.sum(support).alias("class_rows"),
            F.collect_list(F.when(of_class, F.struct("label", *METRICS, "support"))).alias(
                "per_class"
            ),
            *means,
        )
    )


def metrics_overall(counts: DataFrame, labels: Labels = fv.CATEGORIES) -> DataFrame:
    """Accuracy, macro and weighted F1 and row count per split."""
    return _per_split(counts, labels).select("split", "accuracy", "macro_f1", "weighted_f1", "n")


def classification_report(counts: DataFrame, labels: Labels = fv.CATEGORIES) -> DataFrame:
    """Per-class rows, then accuracy, macro and weighted averages, per split."""

    def line(label: str, values: Sequence[Column], support: str) -> Column:
        cells = [v.cast("double").alias(c) for v, c in zip(values, METRICS)]
        return F.struct(F.lit(label).alias("label"), *cells, F.col(support).alias("support"))

    none = F.lit(None)
    extra = F.array(
        line("accuracy", [none, none, F.col("accuracy")], "n"),
        *[
            line(f"{kind} avg", [F.col(f"{kind}_{c}") for c in METRICS], "class_rows")
            for kind in ("macro", "weighted")
        ],
    )
    return _per_split(counts, labels).select("split", F.inline(F.concat("per_class", extra)))


def metrics_compare(
    counts: DataFrame, labels: Labels = fv.CATEGORIES, splits: Sequence[str] = ("val", "test")
) -> DataFrame:
    """Per-class metrics of several splits side by side, three decimals."""
    per_class = metrics_per_class(counts, labels)
    parts = []
    for s in splits:
        here = F.col("split") == s
        for c, short in (("precision", "P"), ("recall", "R"), ("f1", "F1")):
            parts.append(F.bround(F.max(F.when(here, F.col(c))), 3).alias(f"{s}_{short}"))
        parts.append(F.max(F.when(here, F.col("support"))).alias(f"{s}_n"))
    return per_class.groupBy("label").agg(*parts)


def confidence_block(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "ticket_id", "split", "conf", (F.col("y_true") == F.col("y_pred")).alias("correct")
    )


def confidence_histogram(predictions: DataFrame, bins: int = fv.CONFIDENCE_BINS) -> DataFrame:
    """Tickets per split, correctness and confidence bin on [0, 1], last bin closed."""
    block = confidence_block(predictions)
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    bin_no = sum(((F.col("conf") >= e).cast("int") for e in edges), F.lit(0))
    return (
        block.where(F.col("conf").between(0.0, 1.0))
        .groupBy("split", "correct", bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def threshold_sweep(
    predictions: DataFrame, thresholds: Sequence[float] = fv.SWEEP_THRESHOLDS
) -> DataFrame:
    """Coverage and accuracy of the tickets at or above each confidence threshold.

    Each ticket is counted once, at its highest threshold; running sums over those few
    rows give the rest. Thresholds that cover nothing are left out.
    """
    steps = sorted(thresholds)
    level = sum(((F.col("conf") >= t).cast("int") for t in steps), F.lit(0))
    per_level = (
        confidence_block(predictions)
        .groupBy("split", level.alias("level"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("right")
        )
    )
    # Every split gets all levels, so that a threshold no ticket sits on is reported.
    zero = F.lit(0).cast("long")
    levels = F.array(
        F.struct("level", "n", "right"),
        *[
            F.struct(F.lit(i).alias("level"), zero.alias("n"), zero.alias("right"))
            for i in range(len(steps) + 1)
        ],
    )
    filled = (
        per_level.select("split", F.inline(levels))
        .groupBy("split", "level")
        .agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    )
    above = Window.partitionBy("split").orderBy(F.desc("level")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    everything = F.sum("n").over(Window.partitionBy("split"))
    running = filled.withColumns(
        {
            "_n": F.sum("n").over(above),
            "_right": F.sum("right").over(above),
            "_all": everything,
        }
    )
    threshold = F.get(F.array(*[F.lit(float(t)) for t in steps]), F.col("level") - 1)
    return running.where((F.col("level") > 0) & (F.col("_n") > 0)).select(
        threshold.alias("threshold"),
        "split",
        F.bround(F.col("_n") / F.col("_all"), 4).alias("coverage"),
        F.bround(F.col("_right") / F.col("_n"), 4).alias("acc_at_or_above"),
        F.col("_n").alias("n"),
    )


def confused_pairs(predictions: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent (true, predicted) mistakes; ties by name."""
    return (
        predictions.where(F.col("y_true") != F.col("y_pred"))
        .groupBy("y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "y_true", "y_pred")
        .limit(n)
    )


def confident_errors(predictions: DataFrame, n: int = 10) -> DataFrame:
    """The mistakes made with the highest confidence."""
    return (
        predictions.where(F.col("y_true") != F.col("y_pred"))
        .select("ticket_id", "split", "y_true", "y_pred", "conf")
        .orderBy(F.desc("conf"), "ticket_id")
        .limit(n)
    )


def quality_gate(
    counts: DataFrame,
    labels: Labels = fv.CATEGORIES,
    targets: Sequence[tuple[str, float]] = fv.TARGETS,
) -> DataFrame:
    """Metric, value, target and outcome per split."""
    overall = metrics_overall(counts, labels)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(t)).alias("target")
            )
            for m, t in targets
        ]
    )
    return overall.select("split", F.inline(rows)).withColumn(
        "passed", F.col("value") >= F.col("target")
    )


def metrics_document(counts: DataFrame, labels: Labels = fv.CATEGORIES) -> DataFrame:
    """One nested row per split, for a JSON sink."""
    cells = F.array(*[F.col(f"`{x}`") for x in labels])
    matrix = (
        confusion_matrix(counts, labels)
        .groupBy("split")
        .agg(
            F.sort_array(F.collect_list(F.struct("y_true", cells.alias("row")))).alias(
                "confusion_matrix"
            )
        )
    )
    return (
        _per_split(counts, labels)
        .select(
            "split",
            "accuracy",
            "macro_f1",
            "weighted_f1",
            "n",
            F.sort_array("per_class").alias("per_class"),
        )
        .join(matrix, "split")
        .withColumn("labels", _labels(labels))
    )
