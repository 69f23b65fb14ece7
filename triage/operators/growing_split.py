"""Splits of a table that grows by batches, equal to a split of the whole.

What a batch adds to the split is kept beside the tickets: its hashes in order, and a count per
category and hash prefix. The counts of all batches add up to those of the whole table, so they say
in which prefix each set ends; of the hashes only these prefixes are read, two at most of a category
and by ranges the files' statistics can skip by. Tickets of earlier batches are never read again:
``moved`` names those whose set is another one now, from the hashes between the old and the new
boundaries.

A batch's counts are written last and make it part of the split, so a batch that failed half-way
is not there, and one appended again under its id changes nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage.operators.columns import require_columns
from triage.operators.split import (
    BROADCAST_CATEGORIES,
    PREFIX_DIGITS,
    bucket_counts,
    label_by,
    last_of_sets,
    set_ends,
    set_of,
    split_hash,
)

# Ranges of hashes named in a filter that files are skipped by; more are looked up by a join.
MOST_RANGES = 2000
HASHES = "category string, ticket_id string, h string, prefix string"
COUNTS = "category string, prefix string, in_bucket long, batch string"
ENDS = "category string, last_test string, last_val string"


@dataclass(frozen=True)
class GrowingSplit:
    """Hashes and counts of the batches so far, under a path that Spark can reach."""

    spark: SparkSession
    path: str
    test_size: str = fv.TEST_SIZE
    val_size: str = fv.VAL_SIZE
    seed: int = fv.SEED
    id_column: str = "ticket_id"

    def append(self, df: DataFrame, batch: str) -> bool:
        """Add a batch of ``(ticket_id, category)`` rows; False if one of that id is there already."""
        if not re.match(r"[A-Za-z0-9_-]+\Z", batch):
            raise ValueError(f"batch ids are letters, digits, - and _: {batch!r}")
        require_columns(df, (self.id_column, "category"))
        if not self.counts().where(F.col("batch") == batch).isEmpty():
            return False
        hashed = df.select(
            F.col("category").cast("string").alias("category"),
            F.col(self.id_column).cast("string").alias("ticket_id"),
            split_hash(F.col(self.id_column), self.seed).alias("h"),
        ).withColumn("prefix", F.substring("h", 1, PREFIX_DIGITS))
        in_order = hashed.repartitionByRange("category", "h").sortWithinPartitions("category", "h")
        in_order.write.mode("overwrite").parquet(self._hashes(batch))
        written = self.spark.read.schema(HASHES).parquet(self._hashes(batch))
        bucket_counts(written).write.mode("overwrite").parquet(f"{self._root}/counts/batch={batch}")
        return True

    def counts(self) -> DataFrame:
        """``(category, prefix, in_bucket, batch)`` of all batches."""
        try:
            return self.spark.read.schema(COUNTS).parquet(f"{self._root}/counts")
        except Exception as missing:  # only an absent folder is an empty split
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], COUNTS)

    def boundaries(self) -> DataFrame:
        """``(category, last_test, last_val)`` of all batches together."""
        counts = self.counts()
        batches = [r["batch"] for r in counts.select("batch").distinct().orderBy("batch").collect()]
        if not batches:
            return self.spark.createDataFrame([], ENDS)
        buckets = counts.groupBy("category", "prefix").agg(F.sum("in_bucket").alias("in_bucket"))
        ends = set_ends(buckets, test_size=self.test_size, val_size=self.val_size)
        rows = ends.limit(MOST_RANGES + 1).collect()
        hashes = self.spark.read.schema(HASHES).parquet(*(self._hashes(b) for b in batches))
        if len(rows) <= MOST_RANGES:
            hashes = _in_any(
                hashes, [_is(F.col("category"), r["_category"]) & (F.col("prefix") == r["_prefix"]) for r in rows]
            )
            ends = self.spark.createDataFrame(rows, ends.schema)
        return last_of_sets(hashes.select("category", "h", "prefix"), ends).select(
            "category", "last_test", "last_val"
        )

    def label(self, df: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
        """Add ``split`` to rows of any batch."""
        ends = self.boundaries() if boundaries is None else boundaries
        rows = ends.limit(BROADCAST_CATEGORIES + 1).collect()
        if len(rows) <= BROADCAST_CATEGORIES:
            ends = F.broadcast(self.spark.createDataFrame(rows, ends.schema))
        return label_by(df, ends, split_hash(F.col(self.id_column), self.seed))

    def moved(self, before: DataFrame, batches: list[str]) -> DataFrame:
        """``(ticket_id, category, was, now)`` of these batches' tickets that changed their set since ``before``.

        ``ticket_id`` is text. Only hashes between old and new boundaries are read, as far as there are not more
        than ``MOST_RANGES`` of them.
        """
        now = self.boundaries().select("category", F.struct("last_test", "last_val").alias("now"))
        was = before.select(F.col("category").alias("_category"), F.struct("last_test", "last_val").alias("was"))
        both = now.join(was, F.col("category").eqNullSafe(F.col("_category"))).drop("_category")
        changed = both.where(~F.col("was").eqNullSafe(F.col("now")))
        rows = changed.limit(MOST_RANGES + 1).collect()
        hashes = self.spark.read.schema(HASHES).parquet(*(self._hashes(b) for b in batches))
        if len(rows) <= MOST_RANGES:
            between = [
                _is(F.col("category"), r["category"]) & (F.col("h") > (low or "")) & (F.col("h") <= (high or ""))
                for r in rows
                for low, high in (
                    sorted((r["was"][s] or "", r["now"][s] or "")) for s in ("last_test", "last_val")
                )
            ]
            hashes = _in_any(hashes, between)
            changed = F.broadcast(self.spark.createDataFrame(rows, changed.schema))
        found = hashes.join(
            changed.withColumnRenamed("category", "_category"), F.col("category").eqNullSafe(F.col("_category"))
        )
        sets = [
            set_of(F.col("h"), F.col(f"{when}.last_test"), F.col(f"{when}.last_val")).alias(when)
            for when in ("was", "now")
        ]
        return found.select("ticket_id", "category", *sets).where("was != now")

    @property
    def _root(self) -> str:
        return f"{self.path.rstrip('/')}/seed-{self.seed}"

    def _hashes(self, batch: str) -> str:
        return f"{self._root}/hashes/{batch}"


def _is(c: Column, value: str | None) -> Column:
    return c.isNull() if value is None else c == value


def _in_any(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, conditions, F.lit(False)))

