"""Checks on and completion of a table's columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Return ``df``, or raise ``ValueError`` naming the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def with_missing_as_null(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add string nulls for the columns ``df`` does not have."""
    absent = {n: F.lit(None).cast("string") for n in names if n not in df.columns}
    return df.withColumns(absent) if absent else df


def by_ticket(df: DataFrame, id_column: str = "ticket_id") -> DataFrame:
    """Partition whole texts by ticket, ahead of unfolding them.

    The number of partitions is given, as the session sets it for shuffles: left open, it
    would be cut down to the size of the texts, which unfold to many times that.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, id_column)
