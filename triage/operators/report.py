"""What a support desk asks of classified tickets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("category", "sentiment", "priority", "routed_to")


def recent_tickets(df: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` latest tickets: a top-n per task, then one merge of the winners."""
    return df.orderBy(F.desc("created_at"), "ticket_id").limit(n)


def ticket_stats(df: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Counts by each dimension as ``(dimension, value, n)``; null values are left out.

    Tickets are first counted per combination, which map tasks do before the shuffle;
    only the few hundred combinations are unfolded.
    """
    combos = df.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("_n"))
    cells = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]
    )
    return (
        combos.select(F.inline(cells), "_n")
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.sum("_n").alias("n"))
    )
