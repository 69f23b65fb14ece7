"""Rule-based topic labels: queue, then tag, then keywords."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage.functions import text as tx
from triage.functions.binding import lookup
from triage.operators.columns import require_columns, with_missing_as_null
from triage.operators.keyword_index import KeywordIndex
from triage.operators.lookup import few_rows

KeywordRules = Sequence[tuple[str, Sequence[str]]]

def rules_from_frame(rules: DataFrame) -> KeywordRules:
    """Keyword rules held as a table ``(rule_no, category, pattern)``.

    Reads the table to the driver, as rules to be tried one by one. Books of more than some
    hundred keywords are better indexed: see ``keyword_index``, which has no limit.
    """
    require_columns(rules, ("rule_no", "category", "pattern"))
    by_category: dict[str, list[str]] = {}
    rows = few_rows(rules.orderBy("rule_no").select("category", "pattern"), "keyword rules")
    for row in rows:
        by_category.setdefault(row["category"], []).append(row["pattern"])
    return list(by_category.items())


def shortest_keywords(keywords: Sequence[str]) -> list[str]:
    """Drop keywords that hold another one: they can never decide a match."""
    return [k for k in keywords if not any(o != k and o in k for o in keywords)]


def _holds_any(blob: Column, keywords: Sequence[str]) -> Column:
    # One loop over an array literal: stops at the first hit, and generated code
    # stays small however long the list is.
    needed = dict.fromkeys(shortest_keywords(keywords))
    return F.exists(F.array(*[F.lit(k) for k in needed]), lambda k: F.contains(blob, k))


def category_by_queue(queue: Column, rules: Mapping[str, str] = fv.QUEUE_CATEGORY) -> Column:
    """Exact, case-sensitive match on the queue name."""
    return lookup(rules, queue).cast("string")


def category_by_tag(tag: Column, rules: Mapping[str, str] = fv.TAG_CATEGORY) -> Column:
    """Match on the trimmed, lower-cased tag."""
    return lookup(rules, F.lower(tx.strip(tag))).cast("string")


def category_by_keyword(blob: Column, rules: KeywordRules = fv.KEYWORD_RULES) -> Column:
    """First category, in rule order, with a keyword inside the rule text."""
    return F.coalesce(
        *[F.when(_holds_any(blob, kws), F.lit(cat)) for cat, kws in rules if kws],
        F.lit(None).cast("string"),
    )


def with_rule_text(df: DataFrame, name: str = "rule_text") -> DataFrame:
    full = with_missing_as_null(df, fv.RULE_TEXT_COLUMNS)
    return full.withColumn(name, tx.rule_text(*fv.RULE_TEXT_COLUMNS))


def map_to_category(
    df: DataFrame,
    *,
    queue_rules: Mapping[str, str] = fv.QUEUE_CATEGORY,
    tag_rules: Mapping[str, str] = fv.TAG_CATEGORY,
    keyword_rules: KeywordRules | KeywordIndex = fv.KEYWORD_RULES,
) -> DataFrame:
    """Add ``category`` and ``label_source``; both null where no rule fires.

    ``keyword_rules`` are tried one by one, or looked up in a ``KeywordIndex``.

    The result is made of projections only, unless the index is too large for one. Each rule's outcome is a column of
    its own, so that the keyword scan is written, and run, once per ticket, and
    only for tickets that queue and tag leave open.
    """
    kept = df.columns
    full = with_rule_text(
        with_missing_as_null(df, ("queue", "tag_1", *fv.RULE_TEXT_COLUMNS)), "_blob"
    )
    early = full.withColumns(
        {
            "_by_queue": category_by_queue(F.col("queue"), queue_rules),
            "_by_tag": category_by_tag(F.col("tag_1"), tag_rules),
        }
    )
    decided = F.coalesce(F.col("_by_queue"), F.col("_by_tag"))
    if isinstance(keyword_rules, KeywordIndex):
        undecided = early.withColumn("_open", F.when(decided.isNull(), F.col("_blob")))
        early = keyword_rules.with_category(undecided, "_open", "_by_keyword")
        by_keyword = F.col("_by_keyword")
    else:
        by_keyword = category_by_keyword(F.col("_blob"), keyword_rules)
    found = early.withColumn("category", F.coalesce(decided, by_keyword))
    source = (
        F.when(F.col("_by_queue").isNotNull(), "queue")
        .when(F.col("_by_tag").isNotNull(), "tag")
        .when(F.col("category").isNotNull(), "keyword")
    )
    columns = [c for c in kept if c not in ("category", "label_source")]
    return found.select(*columns, "category", source.alias("label_source"))


def keep_labelled(df: DataFrame, **rules) -> DataFrame:
    """As ``map_to_category``, without the tickets no rule could place.

    A filter on the computed label would be pushed below the projection and the
    keyword scan run twice; flattening the 0-or-1 labels drops the row instead.
    """
    labelled = map_to_category(df, **rules)
    found = F.struct("category", "label_source")
    rest = [c for c in labelled.columns if c not in ("category", "label_source")]
    hits = F.filter(F.array(found), lambda x: x["category"].isNotNull())
    return labelled.select(*rest, F.inline(hits))


def filter_language(df: DataFrame, language: str = "en") -> DataFrame:
    """Exact match; reaches the file scan as a pushed filter."""
    return df.where(F.col("language") == language)


def build_labeled(
    raw: DataFrame,
    *,
    english_only: bool = True,
    id_column: str = "ticket_id",
    **rules,
) -> DataFrame:
    """Raw tickets to ``(ticket_id, text, category)``: one map-only stage."""
    require_columns(raw, fv.REQUIRED_COLUMNS)
    rows = filter_language(raw) if english_only and "language" in raw.columns else raw
    # Equivalent to a test on the assembled text, but readable by the scan filter.
    rows = rows.where(tx.has_content("subject") | tx.has_content("body"))
    ids = [id_column] if id_column in raw.columns else []
    return keep_labelled(rows, **rules).select(
        *ids, tx.assemble_text("subject", "body").alias("text"), "category"
    )


def label_source_profile(df: DataFrame, **rules) -> DataFrame:
    """How many tickets each rule kind places in each category."""
    return (
        map_to_category(df, **rules)
        .groupBy("label_source", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
