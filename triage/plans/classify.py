"""From a table of raw tickets to category, sentiment, priority and team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage.functions import polarity as po
from triage.operators.columns import with_missing_as_null
from triage.operators.label import map_to_category
from triage.operators.model import TopicModel, predict_with_confidence
from triage.operators.report import recent_tickets
from triage.operators.sentiment import Phrases, analyze_sentiment, negative_intensity
from triage.operators.triage_rules import (
    accepted,
    priority_level,
    priority_score,
    team,
    validate_tickets,
)

OUTPUT = (
    "ticket_id",
    "category",
    "category_confidence",
    "sentiment",
    "sentiment_scores",
    "priority",
    "priority_score",
    "routed_to",
    "urgency_signals",
)


def with_ticket_id(df: DataFrame) -> DataFrame:
    """Ids as strings; tickets without one get an id derived from their text."""
    derived = F.concat(F.lit("tkt_"), F.md5(F.col("text").cast("binary")))
    if "ticket_id" not in df.columns:
        return df.withColumn("ticket_id", derived)
    return df.withColumn("ticket_id", F.coalesce(F.col("ticket_id").cast("string"), derived))


def _category_by_rules(df: DataFrame) -> DataFrame:
    """Label from the rules; a request that is only a text is scanned as a body."""
    if "body" not in df.columns:
        df = df.withColumn("body", F.col("text"))
    labelled = map_to_category(with_missing_as_null(df, fv.REQUIRED_COLUMNS))
    sure = F.when(F.col("category").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    return labelled.withColumn("category_confidence", sure)


def _respond(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Priority, team and the columns of the response."""
    hits = F.col("_sentiment.scores.urgency_hits")
    scored = df.withColumn(
        "_score",
        priority_score(
            hits,
            negative_intensity(F.col("_sentiment.scores.neg"), hits),
            F.col("customer_plan"),
            F.col("category_confidence"),
        ),
    )
    scores = [F.col(f"_sentiment.scores.{c}").alias(c) for c in ("neg", "neu", "pos", "compound")]
    return scored.select(
        "ticket_id",
        "category",
        "category_confidence",
        F.col("_sentiment.label").alias("sentiment"),
        F.struct(*scores).alias("sentiment_scores"),
        priority_level(F.col("_score")).alias("priority"),
        F.round("_score").cast("int").alias("priority_score"),
        team(F.col("category")).alias("routed_to"),
        F.col("_sentiment.urgency_signals").alias("urgency_signals"),
        *keep,
    )


def classify(
    df: DataFrame,
    *,
    mode: str = "rules",
    model: TopicModel | None = None,
    keep: tuple[str, ...] = (),
    lexicon: po.Lexicon | None = None,
    phrases: Phrases = fv.URGENCY_PHRASES,
    max_chars: int | None = None,
) -> DataFrame:
    """Classify valid tickets; rejected ones are left to ``validate_tickets``.

    Texts may be of any length unless ``max_chars`` sets a bound.

    ``mode="rules"`` is one chain of projections and runs unchanged on a stream.
    ``mode="model"`` takes the category from a fitted model; only ids and short
    results, never texts, are exchanged to bring the parts together.
    """
    valid = with_ticket_id(accepted(validate_tickets(df, max_chars=max_chars)))
    if mode == "rules":
        labelled = _category_by_rules(valid)
        rated = analyze_sentiment(labelled, name="_sentiment", lexicon=lexicon, phrases=phrases)
        return _respond(rated, keep)
    if mode != "model" or model is None:
        raise ValueError("mode must be 'rules', or 'model' with a model")
    rated = analyze_sentiment(
        valid.select("ticket_id", "text", "customer_plan", *keep),
        name="_sentiment",
        lexicon=lexicon,
        phrases=phrases,
    ).drop("text")
    topics = predict_with_confidence(valid, model).select(
        "ticket_id", "category", F.col("confidence").alias("category_confidence")
    )
    return _respond(rated.join(topics, "ticket_id"), keep)


def recent_classified(df: DataFrame, n: int = 20, **options) -> DataFrame:
    """The ``n`` latest valid tickets by ``created_at``, classified: only those are scanned."""
    valid = accepted(validate_tickets(with_ticket_id(df), max_chars=options.get("max_chars")))
    return classify(recent_tickets(valid, n), keep=("created_at",), **options)
