"""Prepare, train and evaluate."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage.operators import evaluate as ev
from triage.operators import model as mo
from triage.operators.label import build_labeled
from triage.operators.profile import prepare_summary
from triage.operators.split import stratified_split
from triage.sources import tickets as src
from triage.sources.folders import write_table, write_through


def with_ids(raw: DataFrame) -> DataFrame:
    """Give raw tickets an id where they have none: the file they lie in and their row there.

    The ids of a Parquet table depend on its files alone. Only rows that come from elsewhere are
    written once more, to have files.
    """
    if "ticket_id" in raw.columns:
        return raw
    try:
        placed = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), "*")
    except AnalysisException:
        copy = raw.sparkSession.read.schema(raw.schema).parquet(write_table(raw, "raw"))
        return with_ids(copy)
    ids = F.concat_ws("-", F.md5(F.col("_file").cast("binary")), F.col("_row").cast("string"))
    return placed.select(ids.alias("ticket_id"), *raw.columns)


def prepare(
    raw: DataFrame, out: str, *, seed: int = fv.SEED, english_only: bool = True
) -> DataFrame:
    """Label, split and write raw tickets; returns the summary of the written table.

    The labelled table is written first: finding the split boundaries reads ids and
    categories twice, and the keyword scan should not run again for that.
    """
    labelled = write_through(
        build_labeled(with_ids(raw), english_only=english_only), "labelled"
    )
    src.write_splits(stratified_split(labelled, seed=seed), out)
    return prepare_summary(raw.sparkSession.read.parquet(out))


def train(
    spark: SparkSession,
    splits_path: str,
    model_path: str,
    metrics_path: str | None = None,
    **options,
) -> DataFrame:
    """Fit on train, score train and val, save model and metrics; returns the metrics."""
    train_rows = src.read_split(spark, splits_path, "train").withColumn("split", F.lit("train"))
    val_rows = src.read_split(spark, splits_path, "val").withColumn("split", F.lit("val"))
    model = mo.fit_topics(train_rows, **options)
    model.save(model_path)
    counts = evaluation_counts(train_rows.unionByName(val_rows), model)
    overall = ev.metrics_overall(counts)
    if metrics_path:
        src.write_metrics(overall, f"{metrics_path}/overall")
        src.write_metrics(ev.classification_report(counts), f"{metrics_path}/report")
        src.write_document(ev.metrics_document(counts), f"{metrics_path}/document")
    return overall


def evaluation_counts(rows: DataFrame, model: mo.TopicModel) -> DataFrame:
    """Confusion counts of a model on labelled rows, written once for all metrics."""
    return write_through(ev.confusion_counts(mo.with_predictions(rows, model)), "confusion")


def evaluate(predictions: DataFrame, labels: tuple[str, ...] = fv.CATEGORIES) -> dict[str, DataFrame]:
    """Every evaluation table of a predictions table, each lazy."""
    counts = ev.confusion_counts(predictions)
    return {
        "overall": ev.metrics_overall(counts, labels),
        "per_class": ev.metrics_per_class(counts, labels),
        "report": ev.classification_report(counts, labels),
        "confusion_matrix": ev.confusion_matrix(counts, labels),
        "compare": ev.metrics_compare(counts, labels),
        "quality_gate": ev.quality_gate(counts, labels),
        "document": ev.metrics_document(counts, labels),
        "confidence": ev.confidence_block(predictions),
        "confidence_histogram": ev.confidence_histogram(predictions),
        "threshold_sweep": ev.threshold_sweep(predictions),
        "confused_pairs": ev.confused_pairs(predictions),
        "confident_errors": ev.confident_errors(predictions),
    }
