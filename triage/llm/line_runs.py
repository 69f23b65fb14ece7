"""Removal of repeated runs of lines through an h-sorted suffix array of line ids.

Every line gets an id. Suffixes (a document from some line on) are ranked by their first
1, 2, 4, ... lines: each round sorts the pairs of ranks 2^k lines apart and numbers them in
order. Suffixes whose first lines occur nowhere else leave after the first round they are
alone in, so the work follows the repeated lines. Two suffixes share their first m lines exactly
if the ranks over 2^k <= m lines agree at the start and 2^k lines before the end, which gives
the longest-common-prefix intervals of any depth without comparing texts.

A repeated run counts if it has ``min_words`` words or more. Doubling stops at the depth that
the threshold needs: a line belongs to such a run if it lies in a shortest sufficient run read
forward from some line, or ends a shortest sufficient one read backward, and runs longer than
these are made of them. Of each interval the first occurrence (by doc_id, then place) stays;
lines of all later ones are deleted. Neighbouring deleted lines are the later copies of
the maximal repeated runs.

Defined results: a null text stays null and has no lines; lines are compared without
surrounding white space; rows alike in doc_id and text are one document and share its fate;
different texts under one id are ordered by their hash, a null id comes first. Columns
other than ``text`` pass through, also if named like internal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triage.llm.tables import Table

DOC = ("doc_id", "th")
PLACE = ("doc_id", "th", "line")


def _th() -> Column:
    return F.xxhash64("text")


def same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, th, line, two hashes and the number of words of every line."""
    return (
        docs.filter("text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), _th().alias("th"), F.posexplode(F.split("text", "\n")).alias("line", "s"))
        .withColumn("s", F.trim(F.regexp_replace("s", r"[\x09-\x0D]", " ")))
        .select(
            *PLACE,
            F.xxhash64("s").alias("h1"),
            F.xxhash64(F.lit("line"), "s").alias("h2"),
            F.regexp_count("s", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        )
    )


def _ranks(df: DataFrame, keys: list[str], name: str) -> Table:
    """The combinations of keys that occur more than once, numbered in their order."""
    return Table(
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
        .orderBy(*keys)
        .withColumn(name, F.monotonically_increasing_id()),
        "ranks",
    )


def later_runs(docs: DataFrame, min_words: int = 10) -> tuple[DataFrame, list[Table]]:
    """(doc_id, th, start, end) of every repeated run that is not its first occurrence.

    Also gives the tables the result reads, for the caller to drop.
    """
    lines = Table(lines_of(docs), "lines")
    level0 = _ranks(lines.df, ["h1", "h2"], "r0")
    by_doc = Window.partitionBy(*DOC).orderBy("line")
    in_run = Window.partitionBy(*DOC, "seg").orderBy("line")
    # Consecutive repeated lines of a document share `seg`. before and upto count words.
    repeated = (
        lines.df.join(level0.df, ["h1", "h2"])
        .groupBy(*PLACE)
        .agg(F.first("r0").alias("r0"), F.first("words").alias("words"))
        .withColumn("seg", F.col("line") - F.row_number().over(by_doc))
        .withColumn("upto", F.sum("words").over(in_run))
        .withColumn("before", F.col("upto") - F.col("words"))
    )
    whole = Window.partitionBy(*DOC, "seg")
    ahead = whole.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing)
    behind = whole.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    table = Table(
        repeated.withColumn("next", F.min("line").over(ahead))
        .withColumn("prev", F.max("line").over(behind))
        .withColumn("total", F.max("upto").over(whole))
        .withColumn("last", F.max("line").over(whole))
        .withColumn("first", F.min("line").over(whole))
        .select(
            *PLACE,
            "seg",
            "r0",
            F.coalesce(F.col("next") - 1, F.when(F.col("total") - F.col("before") >= min_words, F.col("last"))).alias("to"),
            F.coalesce(F.col("prev") + 1, F.when(F.col("upto") >= min_words, F.col("first"))).alias("from"),
        ),
        "suffixes",
    )
    longest = table.df.agg(F.greatest(F.max(F.col("to") - F.col("line")), F.max(F.col("line") - F.col("from")))).first()[0]
    level = 0
    lines.drop()
    level0.drop()
    while longest is not None and (2 << level) <= longest + 1:
        table = _double(table, level)
        level += 1
    runs = Table(_named(table.df, level), "runs")
    table.drop()
    firsts = Table(
        runs.df.groupBy("m", "a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "start")).alias("at")).filter("n > 1").drop("n"),
        "first-runs",
    )
    later = (
        runs.df.join(firsts.df, ["m", "a", "b"])
        .filter(F.struct("doc_id", "th", "start") != F.col("at"))
        .select(*DOC, "start", "end")
    )
    return later, [runs, firsts]


def _double(table: Table, level: int) -> Table:
    """Ranks over 2^(level + 1) lines from the ranks over 2^level."""
    r, new = f"r{level}", f"r{level + 1}"
    in_run = Window.partitionBy(*DOC, "seg").orderBy("line")
    paired = Table(table.df.withColumn("then", F.lead(r, 1 << level).over(in_run)), "pairs")
    table.drop()
    ranks = _ranks(paired.df.filter(F.col(r).isNotNull() & F.col("then").isNotNull()), [r, "then"], new)
    out = Table(paired.df.join(ranks.df, [r, "then"], "left").drop("then"), "suffixes")
    paired.drop()
    ranks.drop()
    return out


def _named(table: DataFrame, level: int) -> DataFrame:
    """The shortest sufficient runs (start, end) with their names (m, a, b).

    m is the number of lines, a and b are the ranks over the largest 2^k <= m lines at the
    start and 2^k lines before the end. Runs that hold a line sequence found once are left out.
    """
    ranks = F.array(*(F.col(f"r{k}") for k in range(level + 1)))
    suffixes = table.select(*PLACE, ranks.alias("ranks"), "to", "from")
    spans = suffixes.select(
        *DOC,
        F.explode(
            F.array(
                F.struct(F.col("line").alias("start"), F.col("to").cast("int").alias("end")),
                F.struct(F.col("from").cast("int").alias("start"), F.col("line").alias("end")),
            )
        ).alias("run"),
    ).select(*DOC, "run.start", "run.end")
    spans = (
        spans.filter("start is not null and end is not null")
        .distinct()
        .withColumn("m", F.col("end") - F.col("start") + 1)
        .withColumn("k", F.floor(F.log2("m") + F.lit(1e-9)).cast("int"))
        .withColumn("tail", F.expr("end + 1 - shiftleft(1, k)"))
    )

    def rank_at(df: DataFrame, place: str, name: str) -> DataFrame:
        own = suffixes.select(
            F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("line").alias("_l"), F.col("ranks").alias("_r")
        )
        at = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col(place) == F.col("_l"))
        return df.join(own, at).withColumn(name, F.get("_r", F.col("k"))).drop("_d", "_t", "_l", "_r")

    named = rank_at(rank_at(spans, "start", "a"), "tail", "b")
    return named.filter("a is not null and b is not null").select(*DOC, "start", "end", "m", "a", "b")


def remove_repeated_lines(docs: DataFrame, min_words: int = 10) -> tuple[DataFrame, list[Table]]:
    """All columns of ``docs`` with ``text`` cut, then _n_lines and _n_removed; tables to drop later."""
    later, tables = later_runs(docs, min_words)
    removed = (
        later.select(F.col("doc_id").alias("_rd"), F.col("th").alias("_rt"), F.explode(F.sequence("start", "end")).alias("_line"))
        .groupBy("_rd", "_rt")
        .agg(F.collect_set("_line").alias("_removed"))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_removed"))
    gone = F.coalesce(F.size("_removed"), F.lit(0))
    out = (
        docs.join(removed, F.col("doc_id").cast("long").eqNullSafe(F.col("_rd")) & (_th() == F.col("_rt")), "left")
        .withColumn("_lines", F.when(F.col("text").isNotNull(), F.split("text", "\n")))
        .withColumn(
            "text",
            F.when(F.col("_removed").isNull(), F.col("text")).otherwise(
                F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
            ),
        )
        .withColumn("_n_lines", F.coalesce(F.size("_lines"), F.lit(0)))
        .withColumn("_n_removed", F.when(F.col("_removed").isNull(), 0).otherwise(gone))
        .drop("_rd", "_rt", "_removed", "_lines")
    )
    return out, tables
