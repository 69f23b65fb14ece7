"""A store of classified tickets, written in batches that count once each.

A batch is written to a folder of its own, its tickets by UTC day and beside them its counts by
dimension; then one small record names the folder, the batch and its tickets by day. Readers take
the folders that records name, so a batch that failed half-way is not there, and one that is
appended again under its id changes nothing. Records are put in place by a rename that does not
replace, so of two writers of one batch one wins. Questions are answered from the parts:

* ``recent`` walks the days in the records from the newest until they hold enough tickets, and
  reads only these days of these folders;
* ``stats`` adds up the batches' counts and reads no ticket.

``compact`` gathers many folders in one and writes a record that replaces theirs; batches keep their
records, so that they still count once. Its generation number is part of the record's name, so two
compactions at once can't both take effect. Old folders stay for readers until ``vacuum``.

Records are as many as batches since the beginning; the driver reads a few lines for each.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.operators.columns import require_columns
from triage.operators.report import DIMENSIONS, recent_tickets, ticket_stats

RECORD = T.StructType(
    [
        T.StructField("batch", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("days", T.ArrayType(T.StructType([T.StructField("day", T.StringType()), T.StructField("n", T.LongType())]))),
        T.StructField("replaces", T.ArrayType(T.StringType())),
        T.StructField("generation", T.LongType()),
    ]
)
STATS_SCHEMA = "dimension string, value string, n long"


def utc_day(stamp: str, kind: T.DataType) -> Column:
    """The day of a time stamp, the same in every session's time zone; null of null."""
    if isinstance(kind, T.TimestampNTZType):
        return F.to_date(stamp)
    return F.date_from_unix_date(F.floor(F.unix_seconds(stamp) / 86400).cast("int"))


@dataclass(frozen=True)
class PredictionStore:
    """Classified tickets with ``ticket_id`` and ``created_at`` under a path that Spark can reach.

    ``schema`` is that of the tickets, for a store without any batch.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    dimensions: Sequence[str] = field(default=DIMENSIONS)

    # --- writing -----------------------------------------------------------------------------

    def append(self, tickets: DataFrame, batch_id: str) -> bool:
        """Add a batch; false, and nothing changed, if a batch of that id is there already."""
        require_columns(tickets, ("ticket_id", "created_at", *self.dimensions))
        name = f"batch-{hashlib.md5(batch_id.encode()).hexdigest()}"
        if self._exists(self._record(name)):
            return False
        folder = uuid.uuid4().hex
        rows = tickets.select(*self.schema.names)
        return self._commit(name, self._write(rows, folder, batch=batch_id))

    def compact(self) -> bool:
        """Gather the folders in use in one; false if there is nothing to gather or another was first."""
        records = self._records()
        active = self._active(records)
        if len(active) < 2:
            return False
        generation = 1 + max(r["generation"] or 0 for r in records)
        folder = uuid.uuid4().hex
        rows = self._tickets(active)
        replaces = [r["folder"] for r in active]
        record = self._write(rows, folder, replaces=replaces, generation=generation, stats=self._stats(active))
        return self._commit(f"compaction-{generation:012d}", record)

    def vacuum(self) -> list[str]:
        """Delete the folders that compactions have replaced; readers that began before may fail."""
        records = self._records()
        kept = {r["folder"] for r in self._active(records)}
        gone = sorted({x for r in records for x in r["replaces"] or []} - kept)
        system = self._system()
        for folder in gone:
            for place in (f"tickets/folder={folder}", f"counts/{folder}"):
                system.delete(self._at(f"{self.path}/{place}"), True)
        return gone

    def _write(self, rows: DataFrame, folder: str, *, batch=None, replaces=(), generation=None, stats=None) -> dict:
        """Write a folder's tickets and counts; the record that would name it."""
        place = f"{self.path}/tickets/folder={folder}"
        dated = rows.withColumn("_day", utc_day("created_at", self.schema["created_at"].dataType))
        # Few files to a day, however many tasks the tickets come from; large days are split among tasks.
        dated.hint("rebalance", F.col("_day")).write.partitionBy("_day").parquet(place)
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_day", T.DateType())])).parquet(place)
        days = written.groupBy(F.col("_day").cast("string").alias("day")).agg(F.count("*").alias("n")).collect()
        counts = stats if stats is not None else ticket_stats(written, self.dimensions)
        counts.coalesce(1).write.parquet(f"{self.path}/counts/{folder}")
        days = sorted((r.asDict() for r in days), key=lambda r: r["day"] or "")
        return {"batch": batch, "folder": folder, "days": days, "replaces": list(replaces), "generation": generation}

    def _commit(self, name: str, record: dict) -> bool:
        """Put a record in place unless there is one of that name."""
        draft = f"{self.path}/drafts/{name}-{record['folder']}"
        out = self._system().create(self._at(draft), True)
        out.write((json.dumps(record) + "\n").encode())
        out.close()
        self._system().mkdirs(self._at(f"{self.path}/records"))
        java = self.spark._jvm
        context = java.org.apache.hadoop.fs.FileContext.getFileContext(
            self._at(self.path).toUri(), self.spark._jsc.hadoopConfiguration()
        )
        options = self.spark.sparkContext._gateway.new_array(java.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = java.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._at(draft), self._at(self._record(name)), options)
        except Exception:  # the file system's own error, by way of the JVM
            if self._exists(self._record(name)):
                return False
            raise
        return True

    # --- reading -----------------------------------------------------------------------------

    def read(self) -> DataFrame:
        """All tickets of all batches."""
        return self._tickets(self._active(self._records()))

    def recent(self, n: int = 20) -> DataFrame:
        """The ``n`` latest tickets, as ``recent_tickets`` of all: only the newest days that hold so many are read."""
        active = self._active(self._records())
        by_day: dict[str | None, int] = {}
        for r in active:
            for d in r["days"]:
                by_day[d["day"]] = by_day.get(d["day"], 0) + d["n"]
        wanted, left = set(), n
        for day in sorted(by_day, key=lambda d: d or "", reverse=True):  # tickets without a time come last
            if left <= 0:
                break
            wanted.add(day)
            left -= by_day[day]
        own = [r for r in active if any(d["day"] in wanted for d in r["days"])]
        oldest = min((d or "" for d in wanted), default="")
        # Every newer day is wanted too, so the walk is one bound on the partition.
        return recent_tickets(self._tickets(own, since=oldest or None), n)

    def stats(self) -> DataFrame:
        """Counts ``(dimension, value, n)``, as ``ticket_stats`` of all tickets, from the batches' counts."""
        return self._stats(self._active(self._records()))

    def batches(self) -> list[str]:
        return sorted(r["batch"] for r in self._records() if r["batch"] is not None)

    def _tickets(self, active: Sequence, since: str | None = None) -> DataFrame:
        parts = [f"{self.path}/tickets/folder={r['folder']}" for r in active if r["days"]]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        keys = [T.StructField("folder", T.StringType()), T.StructField("_day", T.DateType())]
        reader = self.spark.read.schema(T.StructType([*self.schema.fields, *keys]))
        table = reader.option("basePath", f"{self.path}/tickets").parquet(*parts)
        rows = table if since is None else table.where(F.col("_day") >= F.lit(since).cast("date"))
        return rows.drop("folder", "_day")

    def _stats(self, active: Sequence) -> DataFrame:
        parts = [f"{self.path}/counts/{r['folder']}" for r in active]
        if not parts:
            return self.spark.createDataFrame([], STATS_SCHEMA)
        table = self.spark.read.schema(STATS_SCHEMA).parquet(*parts)
        return table.groupBy("dimension", "value").agg(F.sum("n").alias("n"))

    def _records(self) -> list:
        if not self._exists(f"{self.path}/records"):
            return []
        return self.spark.read.schema(RECORD).json(f"{self.path}/records").collect()

    @staticmethod
    def _active(records: Sequence) -> list:
        """Records of the folders in use, in a fixed order."""
        gone = {x for r in records for x in r["replaces"] or []}
        return sorted((r for r in records if r["folder"] not in gone), key=lambda r: r["folder"])

    def _record(self, name: str) -> str:
        return f"{self.path}/records/{name}.json"

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._system().exists(self._at(path))
