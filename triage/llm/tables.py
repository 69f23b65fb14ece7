"""Small helpers the operators share: intermediate tables, batches for Python tasks, id columns."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.sources.folders import work_folder


SLICE_BYTES = 4 << 20


class Table:
    """A table written to the shared folder; ``drop`` deletes it when nothing reads it any more."""

    def __init__(self, df: DataFrame, purpose: str):
        self.spark = df.sparkSession
        self.path = work_folder(self.spark, purpose)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_folder(self.spark, self.path)


def drop_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@cache
def _zipped() -> str:
    """The package as a zip file on the driver, for Spark to hand to the executors."""
    root = Path(__file__).resolve().parents[2]
    return shutil.make_archive(f"{tempfile.mkdtemp(prefix='triage-code-')}/triage_code", "zip", root, "triage")


@cache
def _ship(application: str) -> None:
    SparkSession.builder.getOrCreate().sparkContext.addPyFile(_zipped())


def ship(spark: SparkSession) -> None:
    """Let the tasks of this application import the package."""
    _ship(spark.sparkContext.applicationId)


def map_lists(
    df: DataFrame,
    schema: str,
    work: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]],
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``mapInArrow`` over plain lists: ``work`` gets and gives dictionaries of columns.

    Batches are handed over in slices of about ``slice_bytes``, since lists of Python objects take
    many times the room of what they were made from.
    """
    ship(df.sparkSession)
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for out in work(x.to_pydict() for b in batches for x in slices(b, slice_bytes)):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def map_arrow(
    df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]
) -> DataFrame:
    """``mapInArrow`` whose ``work`` gets record batches and gives dictionaries of columns."""
    ship(df.sparkSession)
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for out in work(batches):
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else _array(v, arrow.field(k).type) for k, v in out.items()}, schema=arrow)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values if hasattr(values, "__len__") and not isinstance(values, range) else list(values), type=kind)


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes."""
    rows = batch.num_rows
    step = max(1, rows * size // max(batch.nbytes, 1))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def id_text(c: str) -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def id_remainder(c: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(id_text(c).cast("binary")) % n


def share_of_ids(c: str, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), id_text(c)), F.lit(1 << 30)) / F.lit(float(1 << 30))
