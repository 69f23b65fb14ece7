"""Urgency phrases and sentiment labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage.functions import polarity as po
from triage.functions import text as tx
from triage.functions.binding import column, let
from triage.operators.lookup import few_rows, join_broadcast
from triage.operators.columns import by_ticket

Phrases = Sequence[tuple[str, float]] | Mapping[str, float]

# A lexicon table is sent to every executor in shards of up to this size. A row is counted as
# its word and its fixed part.
BROADCAST_BYTES = 128 * 1024 * 1024
ROW_BYTES = 80


def phrases_from_frame(df: DataFrame) -> list[tuple[str, float]]:
    """Urgency phrases held as a table ``(phrase_no, phrase, delta)``, in that order.

    Reads the table to the driver: it is a rule book and does not grow with tickets.
    """
    rows = few_rows(df.orderBy("phrase_no").select("phrase", "delta"), "phrases")
    return [(r["phrase"], float(r["delta"])) for r in rows]


def urgency_hits(text: Column | str, phrases: Phrases = fv.URGENCY_PHRASES) -> Column:
    """``array<struct<phrase, delta>>`` of the phrases inside the text, in list order."""
    pairs = list(phrases.items() if isinstance(phrases, Mapping) else phrases)
    none = F.array().cast("array<struct<phrase:string,delta:double>>")
    if not pairs:
        return none
    known = F.array(
        *[F.struct(F.lit(p).alias("phrase"), F.lit(float(d)).alias("delta")) for p, d in pairs]
    )
    found = let(
        F.lower(column(text)),
        lambda low: F.filter(known, lambda p: F.contains(low, p["phrase"])),
    )
    return F.coalesce(found, none)


def urgency_signals(text: Column | str, phrases: Phrases = fv.URGENCY_PHRASES) -> Column:
    return F.transform(urgency_hits(text, phrases), lambda h: h["phrase"])


def boost_compound(compound: Column, hits: Column) -> Column:
    """Compound score plus the phrases' deltas, the sum held to ±0.60, the result to ±1."""
    total = F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["delta"])
    cap = fv.URGENCY_DELTA_CAP
    held = F.greatest(F.lit(-cap), F.least(F.lit(cap), total))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), compound + held))


def sentiment_label(compound: Column, neg: Column, hits: Column) -> Column:
    escalated = (hits >= fv.ANGRY_HITS) & (neg >= fv.ANGRY_NEG)
    return (
        F.when((compound < fv.ANGRY_BELOW) | escalated, "Angry")
        .when(compound < fv.FRUSTRATED_BELOW, "Frustrated")
        .when(compound >= fv.POSITIVE_FROM, "Positive")
        .otherwise("Neutral")
    )


def negative_intensity(neg: Column, hits: Column) -> Column:
    """Negative share plus 0.10 per hit, at most 0.30, the sum held to 0..1."""
    bonus = F.least(F.lit(fv.INTENSITY_PER_HIT) * hits, F.lit(fv.INTENSITY_HIT_CAP))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), neg + bonus))


def _with_label(df: DataFrame, name: str, scored: str, hits: str) -> DataFrame:
    count = F.size(hits)
    boosted = df.withColumn("_compound", boost_compound(F.col(f"{scored}.compound"), F.col(hits)))
    scores = F.struct(
        F.col(f"{scored}.neg").alias("neg"),
        F.col(f"{scored}.neu").alias("neu"),
        F.col(f"{scored}.pos").alias("pos"),
        F.col("_compound").alias("compound"),
        count.alias("urgency_hits"),
    )
    result = F.struct(
        sentiment_label(F.col("_compound"), F.col(f"{scored}.neg"), count).alias("label"),
        scores.alias("scores"),
        F.transform(hits, lambda h: h["phrase"]).alias("urgency_signals"),
    )
    return boosted.withColumn(name, result).drop("_compound", scored, hits)


def _neutral() -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.struct(zero.alias("neg"), one.alias("neu"), zero.alias("pos"), zero.alias("compound"))


def analyze_sentiment(
    df: DataFrame,
    text: str = "text",
    *,
    name: str = "sentiment",
    lexicon: po.Lexicon | None = None,
    phrases: Phrases = fv.URGENCY_PHRASES,
) -> DataFrame:
    """Add ``struct<label, scores, urgency_signals>``; blank and null texts are Neutral.

    Projections only, so it also runs on a stream.
    """
    tx.require_string(df, text)
    filled = tx.has_content(text)
    scored = df.withColumns(
        {
            "_polarity": F.when(filled, po.polarity(text, lexicon)).otherwise(_neutral()),
            "_hits": F.when(filled, urgency_hits(text, phrases)).otherwise(
                F.array().cast("array<struct<phrase:string,delta:double>>")
            ),
        }
    )
    return _with_label(scored, name, "_polarity", "_hits")


def analyze_sentiment_by_join(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "text",
    *,
    id_column: str = "ticket_id",
    name: str = "sentiment",
    phrases: Phrases = fv.URGENCY_PHRASES,
) -> DataFrame:
    """As ``analyze_sentiment`` with the lexicon as a table ``(token, kind, value)``.

    For word lists too long for a literal. Ids must be unique. The tickets are partitioned by id
    before they are cut into words, so words are looked up and put back together in place.
    """
    tx.require_string(df, text)
    words = lexicon.groupBy(F.col("token").alias("_word")).agg(
        F.max(F.when(F.col("kind") == "valence", F.col("value").cast("double"))).alias("_valence"),
        F.max(F.when(F.col("kind") == "degree", F.col("value").cast("double"))).alias("_degree"),
        F.max(F.col("kind") == "negation").alias("_negates"),
    )
    size = words.agg(F.sum(F.octet_length("_word") + ROW_BYTES)).first()[0] or 0
    tickets = by_ticket(df, id_column)
    pieces = tickets.where(tx.has_content(text)).select(
        id_column, F.posexplode(po.tokens(text)).alias("_at", "_token")
    ).withColumn("_word", F.col("_token.word"))
    rated = (
        join_broadcast(pieces, words, ["_word"], n_bytes=size, limit=BROADCAST_BYTES)
        .select(
            id_column,
            F.struct(
                F.col("_at").alias("at"),
                po.rated(
                    F.col("_token"), F.col("_valence"), F.col("_degree"), F.col("_negates")
                ).alias("token"),
            ).alias("_item"),
        )
        .groupBy(id_column)
        .agg(F.sort_array(F.collect_list("_item")).alias("_items"))
        .select(id_column, F.transform("_items", lambda x: x["token"]).alias("_tokens"))
    )
    polarity = let(
        F.col("_tokens"),
        lambda toks: po.summarize(
            po.values(toks, po.Modifiers.from_fields()), po.emphasis(F.col(text))
        ),
    )
    scored = tickets.join(rated, id_column, "left").withColumns(
        {
            "_polarity": F.when(F.col("_tokens").isNotNull(), polarity).otherwise(_neutral()),
            "_hits": F.when(tx.has_content(text), urgency_hits(text, phrases)).otherwise(
                F.array().cast("array<struct<phrase:string,delta:double>>")
            ),
        }
    )
    return _with_label(scored.drop("_tokens"), name, "_polarity", "_hits")
