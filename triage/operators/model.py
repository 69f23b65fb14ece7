"""Topic classifier: one weighted logistic regression per class over TF-IDF features.

One class against the rest, with a squared penalty on all coefficients, the intercept
included, plus C times the weighted loss, where a class's weight applies to its own
rows and the others count once: the formulation of LIBLINEAR. The fitted model is a
table of terms with one coefficient per class; scoring is a join and a sum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage import fixed_values as fv
from triage.functions import grams as gr
from triage.functions.binding import let
from triage.operators import features as ft
from triage.operators.columns import require_columns
from triage.operators.lookup import few_rows
from triage.operators.solver import Blocks, Problem, fit_logistic
from triage.sources.folders import write_through

# Under a bound set by the caller, classes with fewer labelled rows are fitted on whole, as far as the bound
# divides by the classes.
CLASS_FLOOR = 1000
# Coefficients are held per class.
MOST_CLASSES = 1000


@dataclass(frozen=True)
class TopicModel:
    """Terms ``(block, term, df, idf, idx, coef)``, class names and intercepts.

    ``coef`` holds one coefficient per class; classes are in alphabetical order.
    """

    terms: DataFrame
    classes: tuple[str, ...]
    intercepts: tuple[float, ...]
    n_terms: int
    n_bytes: int
    n_docs: int

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        facts = spark.range(1).select(
            F.array(*[F.lit(c) for c in self.classes]).alias("classes"),
            F.array(*[F.lit(b) for b in self.intercepts]).alias("intercepts"),
            F.lit(self.n_terms).cast("long").alias("n_terms"),
            F.lit(self.n_bytes).cast("long").alias("n_bytes"),
            F.lit(self.n_docs).cast("long").alias("n_docs"),
        )
        facts.write.mode("overwrite").parquet(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TopicModel:
        facts = spark.read.parquet(f"{path}/facts").first()
        return TopicModel(
            spark.read.parquet(f"{path}/terms"),
            tuple(facts["classes"]),
            tuple(facts["intercepts"]),
            facts["n_terms"],
            facts["n_bytes"],
            facts["n_docs"],
        )


def classes(df: DataFrame, label: str = "category") -> DataFrame:
    return df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label)


def class_sizes(df: DataFrame, label: str = "category") -> dict[str, int]:
    """Rows per class, alphabetical; one row per class reaches the driver."""
    rows = few_rows(df.where(F.col(label).isNotNull()).groupBy(label).count(), "classes", MOST_CLASSES)
    return {r[label]: r["count"] for r in sorted(rows, key=lambda r: r[label])}


def fit_topics(
    df: DataFrame,
    text: str = "text",
    *,
    label: str = "category",
    id_column: str = "ticket_id",
    class_weight: str | Mapping[str, float] | None = "balanced",
    C: float = fv.C,
    max_iter: int = fv.MAX_ITER,
    tol: float = 1e-4,
    min_df: int = fv.MIN_DF,
    max_df: float = fv.MAX_DF,
    max_fit_rows: int | None = None,
) -> TopicModel:
    """Fit vocabulary and coefficients.

    Vocabulary and coefficients come from every labelled row. Features are built once and kept by
    block of terms; every pass of the solver is a distributed sum of gradients over them. Only a caller
    that sets ``max_fit_rows`` has, of a larger table, those rows taken whose hashed id falls below
    their class's share, which leaves every class at least ``CLASS_FLOOR`` rows or all it has; rows
    then count for those they stand for, and classes are weighted by their sizes in the whole table.
    """
    require_columns(df, (id_column, text, label))
    labelled = df.where(F.col(label).isNotNull())
    full = class_sizes(labelled, label)
    rows, sizes = (labelled, full) if max_fit_rows is None else _fit_rows(labelled, label, id_column, max_fit_rows, full)
    if len(sizes) < 2:
        raise ValueError("training needs at least two classes")
    names = list(sizes)
    total = sum(sizes.values())
    vocab = ft.fit_tfidf(
        rows, text, min_df=min_df, max_df=max_df, id_column=id_column, n_docs=total
    )
    if not vocab.n_terms:
        raise ValueError("no terms: change min_df or max_df")
    if class_weight == "balanced":
        weights = {c: sum(full.values()) / (len(sizes) * full[c]) for c in names}
    else:
        weights = {c: float((class_weight or {}).get(c, 1.0)) for c in names}

    numbers = F.array_position(F.array(*[F.lit(c) for c in names]), F.col(label)) - 1
    features = ft.sparse_rows(rows, vocab, text, keep=(label,), id_column=id_column).select(
        numbers.cast("int").alias("label_no"), "indices", "values"
    )
    # A term's entries are the tickets that hold it.
    n_entries = vocab.terms.agg(F.sum("df")).first()[0]

    share = total / sum(full.values())
    stands_for = tuple(share * full[c] / sizes[c] for c in names) if share < 1 else ()

    def problem(i: int, rest_weight: float) -> Problem:
        return Problem(i, sizes[names[i]], total, weights[names[i]], rest_weight, stands_for)

    if len(names) == 2:
        problems = [problem(1, weights[names[0]])]
    else:
        problems = [problem(i, 1.0) for i in range(len(names))]
    coef, intercepts = fit_logistic(features, problems, C=C, tol=tol, max_iter=max_iter, n_entries=n_entries)
    found = F.coalesce("coef", F.array(*[F.lit(0.0)] * len(problems)))
    if len(names) == 2:
        found, intercepts = F.array(-F.get(found, F.lit(0)), F.get(found, F.lit(0))), [-intercepts[0], intercepts[0]]
    terms = write_through(vocab.terms.join(coef, "idx", "left").withColumn("coef", found), "topic-terms")
    return TopicModel(
        terms,
        tuple(names),
        tuple(intercepts),
        vocab.n_terms,
        vocab.n_bytes + 8 * len(names) * vocab.n_terms,
        vocab.n_docs,
    )


def _fit_rows(
    rows: DataFrame, label: str, id_column: str, most: int, sizes: dict[str, int] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """The rows to fit on and how many of each class there are; ``sizes`` of all classes if known."""
    sizes = sizes or class_sizes(rows, label)
    total = sum(sizes.values())
    if total <= most:
        return rows, sizes
    floor = max(1, min(CLASS_FLOOR, most // len(sizes)))
    cuts = [
        x
        for c, n in sizes.items()
        for x in (F.lit(c), F.lit(int(min(1.0, max(floor, most / total * n) / n) * (1 << 30))))
    ]
    place = F.pmod(F.xxhash64(F.lit("fit"), F.col(id_column).cast("string")), F.lit(1 << 30))
    chosen = rows.where(place < F.element_at(F.create_map(*cuts), F.col(label)))
    return chosen, class_sizes(chosen, label)


def decision_function(
    df: DataFrame, model: TopicModel, text: str = "text", *, id_column: str = "ticket_id"
) -> DataFrame:
    """``(ticket_id, scores)``: raw score per class.

    A ticket's terms are counted, weighed and summed in its shard's task. Copies of a text that
    share an id are scored as one.
    """
    terms = model.terms.select("block", "term", "idf", "idx", "coef")
    shards = ft.look_up_terms(df, terms, text, id_column=id_column)
    task = gr.scores(ft.BLOCKS, ft.SPANS, id_column, ft.BLOCK_WEIGHTS, tuple(model.intercepts))
    kind = df.schema[id_column].dataType.simpleString()
    return shards.applyInArrow(task, f"`{id_column}` {kind}, scores array<double>")


def predict_proba(
    df: DataFrame, model: TopicModel, text: str = "text", *, id_column: str = "ticket_id"
) -> DataFrame:
    """``(ticket_id, proba)``: logistic of each class score, scaled to sum to 1."""
    scored = decision_function(df, model, text, id_column=id_column)
    return scored.select(id_column, probabilities(F.col("scores")).alias("proba"))


def probabilities(scores: Column) -> Column:
    """Logistic of each score, scaled to sum to 1."""
    each = F.transform(scores, lambda s: 1.0 / (1.0 + F.exp(-s)))
    return let(
        each,
        lambda p: let(
            F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(p, lambda x: x / total)
        ),
    )


def best_class(proba: Column, model: TopicModel) -> tuple[Column, Column]:
    """(category, confidence); ties go to the first class."""
    names = F.array(*[F.lit(c) for c in model.classes])
    best = F.array_max(proba)
    return F.get(names, (F.array_position(proba, best) - 1).cast("int")), best


def predict_with_confidence(
    df: DataFrame, model: TopicModel, text: str = "text", *, id_column: str = "ticket_id"
) -> DataFrame:
    """``(ticket_id, category, confidence, scores)``; ties go to the first class."""
    names = F.array(*[F.lit(c) for c in model.classes])
    category, confidence = best_class(F.col("proba"), model)
    return predict_proba(df, model, text, id_column=id_column).select(
        id_column,
        category.alias("category"),
        confidence.alias("confidence"),
        F.map_from_arrays(names, "proba").alias("scores"),
    )


def predict(
    df: DataFrame, model: TopicModel, text: str = "text", *, id_column: str = "ticket_id"
) -> DataFrame:
    return predict_with_confidence(df, model, text, id_column=id_column).select(
        id_column, "category"
    )


def feature_names(model: TopicModel) -> DataFrame:
    return model.terms.select("idx", "block", "term")


def top_features(model: TopicModel, n: int = fv.TOP_FEATURES) -> DataFrame:
    """The ``n`` terms with the highest coefficients per class."""
    names = F.array(*[F.lit(c) for c in model.classes])
    long = model.terms.select("block", "term", F.posexplode("coef").alias("_c", "coef"))
    order = Window.partitionBy("_c").orderBy(F.desc("coef"), "block", "term")
    return (
        long.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select(F.get(names, "_c").alias("category"), "rank", "block", "term", "coef")
    )


def vocabulary_of(model: TopicModel) -> ft.TfidfModel:
    return ft.TfidfModel(model.terms, model.n_terms, model.n_bytes, model.n_docs)


def score_features(
    features: DataFrame,
    model: TopicModel,
    *,
    keep: tuple[str, ...] = ("category",),
    id_column: str = "ticket_id",
) -> DataFrame:
    """``(ticket_id, …keep, scores)`` from the rows of ``sparse_rows``, which need no text again.

    The rows are read once, to lie by block of terms with their coefficients; the result is written.
    """
    own = list(dict.fromkeys([id_column, *keep]))
    blocks = _scored_blocks(features, own, model)
    try:
        scores = blocks.scores(len(model.intercepts)) + np.asarray(model.intercepts)[:, None]
        return write_through(blocks.rows(scores, "scores", features.schema), "scores")
    finally:
        blocks.close()


def _scored_blocks(features: DataFrame, own: Sequence[str], model: TopicModel) -> Blocks:
    n_entries = features.agg(F.coalesce(F.sum(F.size("indices")), F.lit(0))).first()[0]
    return Blocks(features, own, n_entries, model.terms, exact=True)


def gradient_norms(
    features: DataFrame,
    model: TopicModel,
    *,
    label: str = "category",
    id_column: str = "ticket_id",
    C: float = fv.C,
) -> DataFrame:
    """``(category, norm, start_norm, smaller_share)`` of the fitted loss, from the saved model.

    Works out each class's gradient at the coefficients and at zero as sums over the features of
    the rows fitted on, without the solver's steps. Balanced class weights are assumed.
    """
    sizes = class_sizes(features, label)
    total, names = sum(sizes.values()), list(model.classes)
    own = {c: total / (len(names) * sizes[c]) for c in names}
    # Of two classes the second is fitted against the first, and both have their weight.
    fitted = [1] if len(names) == 2 else range(len(names))
    number = (F.array_position(F.array(*[F.lit(c) for c in names]), F.col(label)) - 1).cast("int")
    blocks = _scored_blocks(features.select(number.alias("label_no"), "indices", "values"), ["label_no"], model)
    try:
        labels = blocks.own_column(np.int32)
        scores = blocks.scores(len(names))
        pulls, factors = [], []
        for k in fitted:
            rest = own[names[0]] if len(names) == 2 else 1.0
            mine = labels == k
            sign, cost = np.where(mine, 1.0, -1.0), np.where(mine, own[names[k]], rest)
            pulls += [-sign * cost * np.exp(-np.logaddexp(0.0, sign * (scores[k] + model.intercepts[k]))), -sign * cost / 2.0]
            factors += [(k, C), (-1, C)]
        squares = blocks.squares(np.stack(pulls), factors)
    finally:
        blocks.close()
    lines = []
    for at, k in enumerate(fitted):
        end = model.intercepts[k] + C * pulls[2 * at].sum()
        start = C * pulls[2 * at + 1].sum()
        smaller = max(min(sizes[names[k]], total - sizes[names[k]]), 1) / total
        norms = [float(np.sqrt(squares[2 * at] + end * end)), float(np.sqrt(squares[2 * at + 1] + start * start))]
        lines += [(c, *norms, float(smaller)) for c in (names if len(names) == 2 else [names[k]])]
    return features.sparkSession.createDataFrame(lines, "category string, norm double, start_norm double, smaller_share double")


def with_predictions(
    df: DataFrame,
    model: TopicModel,
    text: str = "text",
    *,
    label: str = "category",
    id_column: str = "ticket_id",
) -> DataFrame:
    """Predictions table ``(ticket_id, split, y_true, y_pred, conf)`` for evaluation."""
    rows = ft.sparse_rows(df, vocabulary_of(model), text, keep=(label, "split"), id_column=id_column)
    return predictions_of(rows, model, label=label, id_column=id_column)


def predictions_of(
    features: DataFrame, model: TopicModel, *, label: str = "category", id_column: str = "ticket_id"
) -> DataFrame:
    """As ``with_predictions`` from the rows of ``sparse_rows`` with the split kept."""
    scored = score_features(features, model, keep=(label, "split"), id_column=id_column)
    category, confidence = best_class(F.col("_proba"), model)
    return scored.withColumn("_proba", probabilities(F.col("scores"))).select(
        F.col(id_column).alias("ticket_id"),
        "split",
        F.col(label).alias("y_true"),
        category.alias("y_pred"),
        confidence.alias("conf"),
    )
