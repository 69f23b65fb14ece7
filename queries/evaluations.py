"""Evaluation tables over the derived predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import names, predictions, q, with_ctes
from triage import fixed_values as fv
from triage.operators import evaluate as ev

CATS = fv.CATEGORIES
METRICS = ("precision", "recall", "f1")


def counts(spark, d):
    return ev.confusion_counts(predictions(spark, d))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


CONFUSION = "SELECT split, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL"
GRID = f"SELECT s.split, l.label FROM (SELECT DISTINCT split FROM confusion) s CROSS JOIN (SELECT unnest([{names(CATS)}]) AS label) l"
PER_CLASS = (
    "SELECT split, label, support, "
    "CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision, "
    "CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM ("
    "SELECT g.split, g.label, "
    "CAST(coalesce(sum(n) FILTER (y_true = label AND y_pred = label), 0) AS DOUBLE) AS hits, "
    "CAST(coalesce(sum(n) FILTER (y_pred = label), 0) AS DOUBLE) AS predicted, "
    "CAST(coalesce(sum(n) FILTER (y_true = label), 0) AS BIGINT) AS support "
    "FROM grid g LEFT JOIN confusion c ON c.split = g.split GROUP BY g.split, g.label)"
)
SCORED = (
    "SELECT *, CASE WHEN precision + recall = 0 THEN 0 "
    "ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM per_class"
)
OVERALL = (
    "SELECT split, accuracy, macro_f1, weighted_f1, n FROM ("
    "SELECT split, sum(n) FILTER (y_true = y_pred) / sum(n) AS accuracy, "
    "CAST(sum(n) AS BIGINT) AS n FROM confusion GROUP BY split) JOIN ("
    "SELECT split, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 "
    "FROM scored GROUP BY split) USING (split)"
)
STEPS = {"confusion": CONFUSION, "grid": GRID, "per_class": PER_CLASS, "scored": SCORED}


def metric_sql(body, **extra):
    return with_ctes(body, "predictions", **STEPS, **extra)


def r6(*columns):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def averages(kind):
    avg = (
        (lambda c: f"avg({c})")
        if kind == "macro"
        else (lambda c: f"sum({c} * support) / sum(support)")
    )
    cells = ", ".join(f"round({avg(c)}, 6) AS {c}" for c in METRICS)
    return (
        f"SELECT split, '{kind} avg' AS label, {cells}, CAST(sum(support) AS BIGINT) AS support "
        "FROM scored GROUP BY split"
    )


SWEEP = ", ".join(str(t) for t in fv.SWEEP_THRESHOLDS)
EDGES = [i * (1.0 / fv.CONFIDENCE_BINS) for i in range(1, fv.CONFIDENCE_BINS)]

QUERIES = {
    "metrics_overall": (
        lambda s, d: rounded(
            ev.metrics_overall(counts(s, d)), "accuracy", "macro_f1", "weighted_f1"
        ),
        metric_sql(
            f"SELECT split, {r6('accuracy', 'macro_f1', 'weighted_f1')}, n FROM overall",
            overall=OVERALL,
        ),
    ),
    "metrics_per_class": (
        lambda s, d: rounded(ev.metrics_per_class(counts(s, d)), *METRICS),
        metric_sql(f"SELECT split, label, {r6(*METRICS)}, support FROM scored"),
    ),
    "classification_report": (
        lambda s, d: rounded(ev.classification_report(counts(s, d)), *METRICS),
        metric_sql(
            f"SELECT split, label, {r6(*METRICS)}, support FROM scored UNION ALL "
            "SELECT split, 'accuracy', NULL, NULL, round(accuracy, 6), n FROM overall "
            f"UNION ALL {averages('macro')} UNION ALL {averages('weighted')}",
            overall=OVERALL,
        ),
    ),
    "confusion_matrix": (
        lambda s, d: ev.confusion_matrix(counts(s, d)),
        metric_sql(
            "SELECT g.split, g.label AS y_true, "
            + ", ".join(
                f"CAST(coalesce(sum(n) FILTER (y_pred = {q(c)}), 0) AS BIGINT) AS \"{c}\""
                for c in CATS
            )
            + " FROM grid g LEFT JOIN confusion c ON c.split = g.split AND c.y_true = g.label "
            "GROUP BY g.split, g.label"
        ),
    ),
    "metrics_compare": (
        lambda s, d: ev.metrics_compare(counts(s, d)),
        metric_sql(
            "SELECT label, "
            + ", ".join(
                f"round_even(max({c}) FILTER (split = '{s}'), 3) AS {s}_{short}"
                for s in ("val", "test")
                for c, short in (("precision", "P"), ("recall", "R"), ("f1", "F1"))
            )
            + ", "
            + ", ".join(f"max(support) FILTER (split = '{s}') AS {s}_n" for s in ("val", "test"))
            + " FROM scored GROUP BY label"
        ),
    ),
    "confidence_block": (
        lambda s, d: ev.confidence_block(predictions(s, d)),
        with_ctes(
            "SELECT ticket_id, split, conf, y_true = y_pred AS correct FROM predictions",
            "predictions",
        ),
    ),
    "confidence_histogram": (
        lambda s, d: ev.confidence_histogram(predictions(s, d)),
        with_ctes(
            "SELECT split, y_true = y_pred AS correct, CAST("
            + " + ".join(f"CAST(conf >= {e!r} AS INTEGER)" for e in EDGES)
            + " AS INTEGER) AS bin, count(*) AS n FROM predictions "
            "WHERE conf BETWEEN 0 AND 1 GROUP BY ALL",
            "predictions",
        ),
    ),
    "threshold_sweep": (
        lambda s, d: ev.threshold_sweep(predictions(s, d)),
        with_ctes(
            "SELECT threshold, split, round_even(count(*) FILTER (conf >= threshold) / count(*), 4) "
            "AS coverage, round_even(count(*) FILTER (conf >= threshold AND y_true = y_pred) / "
            "count(*) FILTER (conf >= threshold), 4) AS acc_at_or_above, "
            "count(*) FILTER (conf >= threshold) AS n FROM predictions CROSS JOIN "
            f"(SELECT CAST(unnest([{SWEEP}]) AS DOUBLE) AS threshold) GROUP BY threshold, split "
            "HAVING count(*) FILTER (conf >= threshold) > 0",
            "predictions",
        ),
    ),
    "confused_pairs": (
        lambda s, d: ev.confused_pairs(predictions(s, d)),
        with_ctes(
            "SELECT y_true, y_pred, count(*) AS n FROM predictions WHERE y_true <> y_pred "
            "GROUP BY ALL ORDER BY n DESC, y_true, y_pred LIMIT 10",
            "predictions",
        ),
    ),
    "confident_errors": (
        lambda s, d: ev.confident_errors(predictions(s, d)),
        with_ctes(
            "SELECT ticket_id, split, y_true, y_pred, conf FROM predictions "
            "WHERE y_true <> y_pred ORDER BY conf DESC, ticket_id LIMIT 10",
            "predictions",
        ),
    ),
    "quality_gate": (
        lambda s, d: rounded(ev.quality_gate(counts(s, d)), "value"),
        metric_sql(
            " UNION ALL ".join(
                f"SELECT split, '{m}' AS metric, round({m}, 6) AS value, "
                f"CAST({t} AS DOUBLE) AS target, {m} >= {t} AS passed FROM overall"
                for m, t in fv.TARGETS
            ),
            overall=OVERALL,
        ),
    ),
}
