"""Ticket tables: raw files, splits, models' input and output."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage import fixed_values as fv
from triage.operators.columns import require_columns, with_missing_as_null


def _strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_SCHEMA = _strings((*fv.REQUIRED_COLUMNS, *fv.OPTIONAL_COLUMNS))

LABELLED_SCHEMA = T.StructType(
    [
        T.StructField("ticket_id", T.StringType()),
        T.StructField("text", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
    ]
)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("ticket_id", T.StringType()),
        T.StructField("text", T.StringType(), False),
        T.StructField("customer_plan", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def missing_as_null(df: DataFrame, texts: Sequence[str] = fv.NA_TEXT) -> DataFrame:
    """Null for cells that spell a missing value."""
    cells = [
        F.when(~F.col(f.name).isin(*texts), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cells)


def read_raw_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw tickets from CSV with newlines and doubled quotes inside cells.

    The header is read to learn the columns, which are all strings; nothing is
    inferred. A multi-line file is one task, so convert large ones with
    ``raw_to_parquet`` once and read that.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.options(**options)
    parts = []
    for p in paths:
        names = reader.csv(p).columns
        part = require_columns(reader.schema(_strings(names)).csv(p), fv.REQUIRED_COLUMNS)
        parts.append(with_missing_as_null(missing_as_null(part), fv.OPTIONAL_COLUMNS))
    return union_sources(*parts)


def read_raw_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    raw = require_columns(spark.read.parquet(*paths), fv.REQUIRED_COLUMNS)
    return with_missing_as_null(missing_as_null(raw), fv.OPTIONAL_COLUMNS)


def raw_to_parquet(spark: SparkSession, csv_path: str | Sequence[str], out: str) -> DataFrame:
    """Convert raw CSV once; the copy is what later jobs read in parallel."""
    write_raw(read_raw_csv(spark, csv_path), out)
    return read_raw_parquet(spark, out)


def union_sources(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, duplicates kept; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_raw(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Train, val and test in one table, partitioned by ``split``."""
    require_columns(df, ("split", "text", "category"))
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the others' files are not listed for reading."""
    table = spark.read.parquet(path)
    require_columns(table, ("text", "category", "split"))
    ids = [c for c in ("ticket_id",) if c in table.columns]
    return table.where(F.col("split") == split).select(*ids, "text", "category")


def append_predictions(df: DataFrame, path: str) -> None:
    """Append classified tickets, partitioned by the date of ``created_at``.

    A repeated append writes twice; ``sources.store.PredictionStore`` takes every batch once.
    """
    require_columns(df, ("created_at",))
    dated = df.withColumn("date", F.to_date("created_at"))
    dated.write.mode("append").partitionBy("date").parquet(path)


def write_metrics(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def write_document(document: DataFrame, path: str) -> None:
    """A few nested rows as one JSON file."""
    document.coalesce(1).write.mode("overwrite").json(path)
