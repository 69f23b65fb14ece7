"""Connected components of a distributed edge table by alternating star contraction.

Each round links every node's larger neighbours, then its smaller ones, to the smallest node
it sees, until nothing changes: about log(n) rounds. Minima are combined before the shuffle, and
each step's input is a written table, so that a hub's edges can be split among tasks. Steps use
a task per ``ROWS`` edges, since many rounds over few edges would else be mostly empty tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm.tables import Table

ROWS = 200_000


def components(edges: DataFrame) -> Table:
    """(id, component) for every end of an edge (a, b): the smallest id reachable.

    Loops and repeated edges do no harm; edges with a null end are left out; no edges, no rows.
    """
    current = Table(_oriented(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "edges")
    mark = None
    while (now := _mark(current.df)) != mark:
        mark = now
        # A star step at most doubles what it reads.
        tasks = 1 + 2 * mark[0] // ROWS
        current = _small_star(_large_star(current, tasks), tasks)
    out = Table(
        current.df.select(F.col("a").alias("id"), F.col("b").alias("component"))
        .unionByName(current.df.select(F.col("b").alias("id"), F.col("b").alias("component")))
        .distinct(),
        "components",
    )
    current.drop()
    return out


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end."""
    return (
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: Table, tasks: int) -> Table:
    """Link all larger neighbours of a node to the smallest of the node and its neighbours."""
    both = edges.df.unionByName(edges.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = Table(
        both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks), "least"
    )
    moved = both.join(least.df, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = Table(moved.coalesce(tasks), "edges")  # may hold edges twice
    least.drop()
    edges.drop()
    return out


def _small_star(edges: Table, tasks: int) -> Table:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = Table(edges.df.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), "least")
    moved = edges.df.join(least.df, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    every = moved.unionByName(least.df.select("a", F.col("m").alias("b")))
    out = Table(_oriented(every).coalesce(tasks), "edges")
    least.drop()
    edges.drop()
    return out
