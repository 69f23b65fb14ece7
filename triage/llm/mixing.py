"""Mixing of sources to target weights by hierarchical budgets, with DataFrame functions only.

The leaves are (domain, language, source). The budget is divided from the root down by the
integer weights of siblings. A child that cannot use its part (its capacity is its tokens times
``max_epochs``) takes what it can; the rest goes to its siblings by their weights. As a parent's
capacity is that of its children, only what all siblings together cannot use reaches the
parent's own siblings. Every leaf then takes whole epochs while its budget lasts, and of the
next epoch the prefix, in an order seeded by the epoch, whose tokens fit into the rest.

The order is by md5 of seed, epoch and id. The prefix is found from token sums per leaf and
first three digits of the hash; only the one group of a leaf in which its budget ends is ranked.

Defined results: null texts have no tokens; null names are the name ``unknown``; weights are 1
where none is given, children of weight 0 get nothing; rows alike in id are in or out together;
a leaf without tokens keeps all its rows once if its weight allows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triage.functions.binding import lookup
from triage.llm.tables import Table, id_text

LEVELS = ("domain", "lang", "source")
#: Up to so many leaves (three names and a few numbers each) their cuts are broadcast.
BROADCAST_LEAVES = 50_000
PREFIX = 3


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), id_text("doc_id")))


def _fill(children: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Divide ``budget`` of each parent among its children by weight, up to their capacity."""
    siblings = Window.partitionBy(*parent)
    ordered = siblings.orderBy((F.col("cap") / F.col("weight")), *LEVELS[: len(parent) + 1])
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    # The level rises while children fill up and falls after the first that does not.
    return (
        children.filter("weight > 0")
        .withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(siblings))
        .withColumn(out, F.least(F.col("cap"), F.floor(F.col("weight") * F.greatest("_level", F.lit(0.0)))))
        .drop("_level")
    )


def budgets(
    leaves: DataFrame, budget: Column, weights: Mapping[str, int], max_epochs: int
) -> DataFrame:
    """domain, lang, source, tokens, budget of every leaf from its token count."""

    def weight(*names: str) -> Column:
        return F.coalesce(lookup(weights, F.concat_ws("/", *names)), F.lit(1)).cast("long")

    leaf = (
        leaves.withColumn("cap", F.col("tokens") * max_epochs)
        .withColumn("weight", weight(*LEVELS))
        .withColumn("w1", weight("domain"))
        .withColumn("w2", weight("domain", "lang"))
    )
    usable = leaf.filter("weight > 0 and w1 > 0 and w2 > 0")
    langs = usable.groupBy("domain", "lang", F.col("w1"), F.col("w2")).agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain", F.col("w1").alias("weight")).agg(F.sum("cap").alias("cap"))
    total = leaves.agg(budget.cast("long").alias("_root"))
    by_domain = _fill(domains.crossJoin(F.broadcast(total)), [], "_root", "_b1").select("domain", "_b1")
    by_lang = _fill(
        langs.withColumnRenamed("w2", "weight").join(by_domain, "domain"), ["domain"], "_b1", "_b2"
    ).select("domain", "lang", "_b2")
    return _fill(usable.join(by_lang, ["domain", "lang"]), ["domain", "lang"], "_b2", "budget").select(
        *LEVELS, "tokens", "budget"
    )


def mix(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, int],
    budget_share: float = 0.6,
    max_epochs: int = 4,
    seed: int = 7,
) -> tuple[DataFrame, list[Table]]:
    """All columns of ``docs``, then _domain, _tokens and _epoch, a row for every epoch that takes it.

    ``weights`` gives integers by path ("web", "web/en", "web/en/src1"); ``budget_share`` is the
    whole budget as a share of the corpus's tokens. Also gives the tables the result reads.
    """

    def named(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("unknown"))

    def leaf_columns(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "_domain": named(domain),
                "_lang": named(F.col("lang")),
                "_source": named(F.col("source")),
                "_tokens": token_count(F.col("text")),
            }
        )

    narrow = Table(
        leaf_columns(docs).select(
            F.col("doc_id"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("tokens")
        ),
        "tokens",
    )
    leaves = narrow.df.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = Table(
        budgets(leaves, F.floor(F.sum("tokens") * budget_share), weights, max_epochs)
        .withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
        .drop("tokens"),
        "leaves",
    )
    few = plan.df.count() <= BROADCAST_LEAVES
    hint = F.broadcast if few else (lambda df: df)
    placed = (
        narrow.df.join(hint(plan.df), list(LEVELS))
        .withColumn("key", order_key(seed, F.col("full")))
        .withColumn("part", F.substring("key", 1, PREFIX))
    )
    sums = placed.groupBy(*LEVELS, "rest", "part").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy(*LEVELS).orderBy("part")
    last = (
        sums.withColumn("before", F.sum("t").over(upto) - F.col("t"))
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest")))
        .select(*LEVELS, "part", "before")
    )
    ranked = Window.partitionBy(*LEVELS).orderBy("key")
    inside = (
        placed.join(hint(last), [*LEVELS, "part"])
        .withColumn("upto", F.col("before") + F.sum("tokens").over(ranked))
        .filter("upto <= rest")
        .groupBy(*LEVELS)
        .agg(F.max("key").alias("cut"))
    )
    cuts = Table(
        plan.df.join(last, list(LEVELS), "left")
        .join(inside, list(LEVELS), "left")
        .select(
            *(F.col(c).alias(f"_c_{c}") for c in LEVELS),
            F.col("full").alias("_full"),
            # "g" is behind all digits, a bare prefix in front of all keys that begin with it.
            F.coalesce("cut", "part", F.lit("g")).alias("_cut"),
        ),
        "cuts",
    )
    narrow.drop()
    plan.drop()
    at = (
        (F.col("_domain") == F.col("_c_domain"))
        & (F.col("_lang") == F.col("_c_lang"))
        & (F.col("_source") == F.col("_c_source"))
    )
    own = leaf_columns(docs).join(hint(cuts.df), at)
    times = F.col("_full") + (order_key(seed, F.col("_full")) <= F.col("_cut")).cast("long")
    taken = (
        own.withColumn("_times", times)
        .filter("_times > 0")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
        .drop("_lang", "_source", "_c_domain", "_c_lang", "_c_source", "_full", "_cut", "_times")
    )
    return taken, [cuts]
