"""Online scoring and running counts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from triage.operators.model import TopicModel
from triage.operators.report import DIMENSIONS
from triage.plans.classify import classify
from triage.sources.store import PredictionStore


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    format: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files that arrive in a folder, those of a name pattern if one is given."""
    reader = spark.readStream.schema(schema).format(format)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def classify_stream(
    tickets: DataFrame,
    out: str,
    checkpoint: str,
    *,
    model: TopicModel | None = None,
    keep: tuple[str, ...] = (),
) -> StreamingQuery:
    """Classify what has arrived and append it to a Parquet table, each ticket once.

    Rules need no state, so the batch plan runs as it is. With a model each micro-batch
    is scored as a batch, since summing a ticket's terms would otherwise be kept as
    stream state; its rows go to a folder of the batch, so that a batch run again after a
    failure replaces its own rows only. ``read_classified`` reads either form.
    """
    if model is None:
        writer = classify(tickets, keep=keep).writeStream.format("parquet").option("path", out)
    else:

        def score(batch: DataFrame, batch_id: int) -> None:
            scored = classify(batch, mode="model", model=model, keep=keep)
            scored.write.mode("overwrite").parquet(f"{out}/{batch_id:020d}")

        writer = tickets.writeStream.foreachBatch(score)
    return (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def store_stream(
    tickets: DataFrame,
    store: PredictionStore,
    checkpoint: str,
    *,
    name: str = "stream",
    model: TopicModel | None = None,
) -> StreamingQuery:
    """Classify what has arrived and append it to a store, a batch of the store for each of the stream.

    A batch run again after a failure has its number, and so its id, again: it counts once, and so
    do the store's counts, which are never rewritten as a whole.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        mode = "rules" if model is None else "model"
        store.append(classify(batch, mode=mode, model=model, keep=("created_at",)), f"{name}-{batch_id}")

    return (
        tickets.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_classified(spark: SparkSession, out: str) -> DataFrame:
    """All tickets that ``classify_stream`` has written so far."""
    if _folders(spark, f"{out}/_spark_metadata"):
        return spark.read.parquet(out)
    return spark.read.option("recursiveFileLookup", True).parquet(out)


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in system.globStatus(path) or [])


def read_stats(spark: SparkSession, out: str) -> DataFrame:
    """The latest complete table of counts that ``stats_stream`` has written."""
    done = _folders(spark, f"{out}/*/_SUCCESS")
    if not done:
        raise ValueError(f"no complete table in {out}")
    return spark.read.parquet(done[-1].removesuffix("/_SUCCESS"))


def stats_stream(
    classified: DataFrame,
    out: str,
    checkpoint: str,
    dimensions: Sequence[str] = DIMENSIONS,
) -> StreamingQuery:
    """Running counts ``(dimension, value, n)``, the whole table anew after each batch.

    The state is one row per value of a dimension, however many tickets pass. Every batch has
    a folder of its own, so readers keep the last complete table until the next is there.
    """
    cells = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]
    )
    running = (
        classified.select(F.inline(cells))
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def replace(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{out}/{batch_id:020d}")

    return (
        running.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
