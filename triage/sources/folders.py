"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="triage-")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/triage-{purpose}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, purpose: str, compression: str | None = None) -> str:
    """Write a table to the work folder; returns its path."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path, compression=compression)
    return path


def write_through(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """Write a table to the work folder and read it back, which cuts its lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, purpose, compression))
