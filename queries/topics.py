"""Features, linear scores and the trained classifier."""

from __future__ import annotations

from functools import cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from queries.common import (
    labelled,
    names,
    requests,
    split_tickets,
    sql_clean,
    sql_words,
    table,
    with_ctes,
)
from queries.texts import split_pieces
from queries.triage_queries import analyzed_sql
from triage import fixed_values as fv
from triage.operators import features as ft
from triage.operators import model as mo
from triage.plans.classify import classify, with_ticket_id
from triage.sources.folders import work_folder, write_table, write_through

CLASSES = tuple(sorted(fv.CATEGORIES))
# What the solver stops at by default, as a share of the smaller class's part of the start.
TOLERANCE = 1e-4


def term_totals(block):
    def run(spark, d):
        counts = ft.count_terms(requests(spark, d), blocks=(block,), combined=True)
        return counts.select("term", "df", "tf")

    return run


def pruned(spark, d):
    rows = requests(spark, d)
    n_docs = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ft.prune(ft.document_frequency(ft.count_terms(rows, combined=True)), n_docs)


def vocabulary(spark, d):
    model = ft.fit_tfidf(requests(spark, d))
    return model.terms.select("idx", "block", "term", "df", F.round("idf", 6).alias("idf"))


def tfidf_by_term(block):
    def run(spark, d):
        rows = requests(spark, d)
        model = ft.fit_tfidf(rows, blocks=(block,))
        weights = ft.tfidf(rows, model, blocks=(block,), weighted=False, combined="term")
        return weights.groupBy("term").agg(
            F.sum("terms").alias("df"),
            F.round(F.sum("total"), 6).alias("total"),
            F.round(F.max("highest"), 6).alias("highest"),
        )

    return run


def tfidf_union(spark, d):
    rows = requests(spark, d)
    weights = ft.tfidf(rows, ft.fit_tfidf(rows), combined="ticket")
    return weights.groupBy("ticket_id", "block").agg(
        F.sum("terms").alias("terms"),
        F.round(F.sum("total"), 6).alias("total"),
        F.round(F.max("highest"), 6).alias("highest"),
    )


def fixed_model(spark, d):
    """A model whose coefficients follow from the term's number, so that SQL can say them."""
    fitted = ft.fit_tfidf(requests(spark, d))
    coef = F.array(*[((F.col("idx") * (i + 3)) % 11 - 5) / 10.0 for i in range(len(CLASSES))])
    terms = fitted.terms.withColumn("coef", coef)
    intercepts = tuple(i / 10.0 for i in range(len(CLASSES)))
    return mo.TopicModel(
        terms, CLASSES, intercepts, fitted.n_terms, fitted.n_bytes, fitted.n_docs
    )


def linear_score(spark, d):
    scored = mo.decision_function(requests(spark, d), fixed_model(spark, d))
    return scored.select(
        "ticket_id",
        *[F.round(F.get("scores", F.lit(i)), 6).alias(f"s{i}") for i in range(len(CLASSES))],
    )


def fixed_proba(spark, d):
    proba = mo.predict_proba(requests(spark, d), fixed_model(spark, d))
    return proba.select(
        "ticket_id",
        *[F.round(F.get("proba", F.lit(i)), 6).alias(f"p{i}") for i in range(len(CLASSES))],
    )


def fixed_confidence(spark, d):
    best = mo.predict_with_confidence(requests(spark, d), fixed_model(spark, d))
    return best.select(
        "ticket_id",
        "category",
        F.round("confidence", 6).alias("confidence"),
        F.round(F.col("scores")["Billing"], 6).alias("billing"),
    )


@cache
def _saved(application: str, d: str) -> tuple[str, str]:
    """Paths of the written split table and of the model fitted on its training part."""
    spark = SparkSession.builder.getOrCreate()
    rows = write_table(split_tickets(spark, d), "splits")
    model = work_folder(spark, "model")
    mo.fit_topics(spark.read.parquet(rows).where(F.col("split") == "train")).save(model)
    return model, rows


def trained(spark, d):
    """The saved model and splits; fitted once per application, by the first query that asks."""
    model, rows = _saved(spark.sparkContext.applicationId, d)
    return mo.TopicModel.load(spark, model), spark.read.parquet(rows)


def fit_report(model, rows):
    """Rows of each split and class, and whether the fit on the training part has converged."""
    features = write_through(
        ft.sparse_rows(rows, mo.vocabulary_of(model), keep=("category", "split")), "report-features", "zstd"
    )
    norms = mo.gradient_norms(features.where(F.col("split") == "train"), model).select(
        "category",
        (F.col("norm") <= 1.01 * TOLERANCE * F.col("smaller_share") * F.col("start_norm")).alias("converged"),
    )
    # Every labelled row is scored; a row is predicted one of the classes with a fair confidence.
    scored = mo.predictions_of(features, model)
    sane = F.col("y_pred").isin(*model.classes) & F.col("conf").between(1.0 / len(model.classes), 1.0)
    sizes = scored.groupBy("split", F.col("y_true").alias("category")).agg(
        F.count(F.lit(1)).alias("support"), F.bool_and(sane).alias("scored")
    )
    return sizes.join(norms, "category").select("split", "category", "support", "scored", "converged")


def train_category(spark, d):
    return fit_report(*trained(spark, d))


def train_quality(spark, d):
    """The other labelled target: document quality, two classes, a fifth held out by id."""
    labels = table(spark, d, "labels").where(F.col("quality").isNotNull())
    held_out = F.col("doc_id") % 5 == 0
    rows = table(spark, d, "documents").join(labels, "doc_id").select(
        F.col("doc_id").alias("ticket_id"),
        "text",
        F.col("quality").cast("string").alias("category"),
        F.when(held_out, "test").otherwise("train").alias("split"),
    )
    rows = write_through(rows, "quality")
    model = mo.fit_topics(rows.where(F.col("split") == "train"))
    return fit_report(model, rows)


def scored_plainly(model, rows, keep=()):
    """(ticket_id, category, confidence) from the saved coefficients, by one row for each ticket and class.

    Shares nothing with the operators but the features: every ticket's entries are multiplied by the
    coefficients and added up where they are found, the logistic of every sum is divided by their total, and
    the largest share, of equal ones the first class's, names the category.
    """
    terms = model.terms.select("block", "term", "idf", "idx", "coef")
    sums = (
        ft.sparse_sums(rows, terms, len(model.classes), keep=keep)
        .select("ticket_id", F.posexplode("sums").alias("at", "sum"))
        .groupBy("ticket_id", "at")
        .agg(F.sum("sum").alias("total"))
    )
    every = F.posexplode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(b)).alias("b")) for c, b in zip(model.classes, model.intercepts)]))
    tickets = rows.select("ticket_id").distinct().select("ticket_id", every.alias("at", "of"))
    share = tickets.join(sums, ["ticket_id", "at"], "left").withColumn(
        "p", 1 / (1 + F.exp(-(F.coalesce("total", F.lit(0.0)) + F.col("of.b"))))
    )
    best = F.max(F.struct("p", (-F.col("at")).alias("first"), F.col("of.c").alias("category"))).alias("best")
    return share.groupBy("ticket_id").agg(best, F.sum("p").alias("all")).select(
        "ticket_id", F.col("best.category").alias("plain_category"), (F.col("best.p") / F.col("all")).alias("plain_confidence")
    )


def agreeing(found, plain, confidence):
    """Whether category and confidence are those of ``scored_plainly``; false where the ticket is missing there."""
    same = (F.col("category") == F.col("plain_category")) & (F.abs(F.col(confidence) - F.col("plain_confidence")) < 1e-9)
    return found.join(plain, "ticket_id", "left").withColumn("agrees", F.coalesce(same, F.lit(False)))


def top_features(spark, d):
    """Ranks of each class; ``in_place`` says that just so many of all terms of the saved model come before a term."""
    model = trained(spark, d)[0]
    top = mo.top_features(model)
    names = F.array(*[F.lit(c) for c in model.classes])
    every = model.terms.select("block", "term", F.posexplode("coef").alias("at", "coef")).select(
        F.get(names, "at").alias("category"), F.struct((-F.col("coef")).alias("c"), "block", "term").alias("key")
    )
    mine = F.struct((-F.col("coef")).alias("c"), "block", "term")
    asked = F.broadcast(top.select("category", "rank", mine.alias("mine")))  # a few rows for each class
    before = (
        every.join(asked, "category")
        .groupBy("category", "rank")
        .agg(F.count_if(F.col("key") < F.col("mine")).alias("before"), F.count_if(F.col("key") == F.col("mine")).alias("here"))
    )
    return before.select("category", "rank", ((F.col("before") == F.col("rank") - 1) & (F.col("here") == 1)).alias("in_place"))


def predict_category(spark, d):
    """Every ticket of the test split; ``agrees`` if its class and confidence follow from the saved coefficients."""
    model, rows = trained(spark, d)
    test = rows.where(F.col("split") == "test")
    found = mo.predict_with_confidence(test, model)
    return agreeing(found, scored_plainly(model, test), "confidence").select("ticket_id", "agrees")


def classify_model(spark, d):
    """What needs no model is exact; category and confidence are those the saved coefficients give."""
    model = trained(spark, d)[0]
    asked = requests(spark, d)
    out = classify(asked, mode="model", model=model)
    plain = scored_plainly(model, with_ticket_id(asked).select("ticket_id", "text"))
    return agreeing(out, plain, "category_confidence").select(
        "ticket_id",
        "agrees",
        "sentiment",
        *[F.col(f"sentiment_scores.{c}").alias(c) for c in ("neg", "neu", "pos")],
        F.round("sentiment_scores.compound", 6).alias("compound"),
        F.array_join("urgency_signals", "|").alias("urgency_signals"),
    )


# --- SQL -----------------------------------------------------------------------------------

CLEANED = f"SELECT ticket_id, {sql_clean('text')} AS text FROM requests"
WORD_TERMS = (
    "SELECT ticket_id, 'word' AS block, unnest(list_concat(t, list_transform("
    "range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM ("
    f"SELECT ticket_id, {split_pieces().replace(sql_clean('text'), 'text')} AS t FROM cleaned)"
)
CHAR_TERMS = (
    "SELECT ticket_id, 'char' AS block, substr(p, i, n) AS term FROM ("
    "SELECT ticket_id, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM ("
    f"SELECT ticket_id, ' ' || unnest({sql_words('text')}) || ' ' AS p FROM cleaned), "
    "(SELECT unnest([3, 4, 5]) AS n))"
)
COUNTED = "SELECT ticket_id, block, term, count(*) AS tf FROM terms GROUP BY ALL"
KEPT = (
    "SELECT block, term, count(*) AS df FROM counted GROUP BY ALL "
    "HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM requests)"
)
VOCABULARY = (
    "SELECT *, ln((1 + (SELECT count(*) FROM requests)) / (1 + df)) + 1 AS idf, "
    "row_number() OVER (ORDER BY block = 'char', term) - 1 AS idx FROM kept"
)
RAW = (
    "SELECT ticket_id, block, term, idx, (1 + ln(tf)) * idf AS w "
    "FROM counted JOIN vocabulary USING (block, term)"
)
UNIT = (
    "SELECT ticket_id, block, term, idx, "
    "w / sqrt(sum(w * w) OVER (PARTITION BY ticket_id, block)) AS weight FROM raw"
)
SCORES = (
    "SELECT r.ticket_id, "
    + ", ".join(
        f"coalesce(sum(weight * CASE WHEN block = 'word' THEN 1.0 ELSE 0.5 END * "
        f"((idx * {i + 3}) % 11 - 5) / 10.0), 0) + {i / 10.0} AS s{i}"
        for i in range(len(CLASSES))
    )
    + " FROM requests r LEFT JOIN unit u ON u.ticket_id = r.ticket_id GROUP BY r.ticket_id"
)
SIGMOID = [f"1 / (1 + exp(-s{i}))" for i in range(len(CLASSES))]
PROBA = (
    "SELECT ticket_id, "
    + ", ".join(f"{x} / ({' + '.join(SIGMOID)}) AS p{i}" for i, x in enumerate(SIGMOID))
    + " FROM scores"
)


def feature_sql(body, *blocks, **extra):
    terms = " UNION ALL ".join({"word": WORD_TERMS, "char": CHAR_TERMS}[b] for b in blocks)
    return with_ctes(
        body,
        "requests",
        cleaned=CLEANED,
        terms=terms,
        counted=COUNTED,
        kept=KEPT,
        vocabulary=VOCABULARY,
        raw=RAW,
        unit=UNIT,
        **extra,
    )


TOTALS = "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM counted GROUP BY term"
BY_TERM = (
    "SELECT term, count(*) AS df, round(sum(weight), 6) AS total, "
    "round(max(weight), 6) AS highest FROM unit GROUP BY term"
)

QUERIES = {
    "word_ngrams": (term_totals("word"), feature_sql(TOTALS, "word")),
    "char_ngrams": (term_totals("char"), feature_sql(TOTALS, "char")),
    "df_prune": (pruned, feature_sql("SELECT block, term, df FROM kept", "word", "char")),
    "vocabulary": (
        vocabulary,
        feature_sql(
            "SELECT idx, block, term, df, round(idf, 6) AS idf FROM vocabulary", "word", "char"
        ),
    ),
    "tfidf_word": (tfidf_by_term("word"), feature_sql(BY_TERM, "word")),
    "tfidf_char": (tfidf_by_term("char"), feature_sql(BY_TERM, "char")),
    "tfidf_union": (
        tfidf_union,
        feature_sql(
            "SELECT ticket_id, block, count(*) AS terms, round(sum(scale * weight), 6) AS total, "
            "round(max(scale * weight), 6) AS highest FROM (SELECT *, "
            "CASE WHEN block = 'word' THEN 1.0 ELSE 0.5 END AS scale FROM unit) GROUP BY ALL",
            "word",
            "char",
        ),
    ),
    "linear_score": (
        linear_score,
        feature_sql(
            "SELECT ticket_id, "
            + ", ".join(f"round(s{i}, 6) AS s{i}" for i in range(len(CLASSES)))
            + " FROM scores",
            "word",
            "char",
            scores=SCORES,
        ),
    ),
    "predict_proba": (
        fixed_proba,
        feature_sql(
            "SELECT ticket_id, "
            + ", ".join(f"round(p{i}, 6) AS p{i}" for i in range(len(CLASSES)))
            + " FROM proba",
            "word",
            "char",
            scores=SCORES,
            proba=PROBA,
        ),
    ),
    "predict_with_confidence": (
        fixed_confidence,
        feature_sql(
            f"SELECT ticket_id, ([{names(CLASSES)}])[list_position(p, list_max(p))] AS category, "
            f"round(list_max(p), 6) AS confidence, round(p[{CLASSES.index('Billing') + 1}], 6) "
            "AS billing FROM (SELECT ticket_id, ["
            + ", ".join(f"p{i}" for i in range(len(CLASSES)))
            + "] AS p FROM proba)",
            "word",
            "char",
            scores=SCORES,
            proba=PROBA,
        ),
    ),
    "classes": (
        lambda s, d: mo.classes(labelled(s, d)),
        with_ctes("SELECT DISTINCT category FROM labelled", "labelled"),
    ),
    "train_category": (
        train_category,
        with_ctes(
            "SELECT split, category, count(*) AS support, true AS scored, true AS converged "
            "FROM split_tickets GROUP BY ALL",
            "split_tickets",
        ),
    ),
    "train_quality": (
        train_quality,
        "SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, "
        "CAST(quality AS VARCHAR) AS category, count(*) AS support, true AS scored, true AS converged "
        "FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL",
    ),
    "top_features": (
        top_features,
        with_ctes(
            "SELECT DISTINCT category, rank, true AS in_place FROM labelled, "
            f"(SELECT unnest(range(1, {fv.TOP_FEATURES} + 1)) AS rank)",
            "labelled",
        ),
    ),
    "predict_category": (
        predict_category,
        with_ctes(
            "SELECT ticket_id, true AS agrees FROM split_tickets WHERE split = 'test'",
            "split_tickets",
        ),
    ),
    "classify_model": (
        classify_model,
        analyzed_sql(
            "SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, true AS agrees, "
            "label AS sentiment, neg, neu, pos, round(compound, 6) AS compound, "
            f"signals AS urgency_signals FROM analyzed WHERE length(text) >= 1 AND customer_plan IN ({names(fv.PLANS)})"
        ),
    ),
}
