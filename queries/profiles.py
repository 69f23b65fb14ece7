"""Counts, statistics, weights and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import (
    labelled,
    q,
    split_tickets,
    sql_words,
    table,
    tickets,
    with_ctes,
)
from triage import fixed_values as fv
from triage.operators import profile as pr
from triage.operators import quantiles as qt
from triage.operators import weights as wt

TYPES = ("Incident", "Request", "Problem", "Change")


def r6(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


def numbered(table):
    return table.withColumn("cat_no", F.col("cat_no").cast("long"))


def top_words(spark, d):
    ranked = pr.top_words(tickets(spark, d), n=12)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def category_counts(spark, d):
    return pr.distribution_zero_filled(labelled(spark, d)).drop("cat_no")


def value_counts(spark, d):
    return pr.value_counts(tickets(spark, d), ["type", "priority", "language", "queue"])


def column_profile(spark, d):
    return pr.column_profile(tickets(spark, d).select(*PROFILED))


def describe_length(spark, d):
    stats = pr.describe_length(tickets(spark, d))
    return stats.select("n", *r6("mean", "std"), "min", "p25", "p50", "p75", "max")


def length_histogram(spark, d):
    return pr.length_histogram(tickets(spark, d)).select("bin", *r6("bin_from", "bin_to"), "n")


def length_boxplot(spark, d):
    box = pr.boxplot(tickets(spark, d), "type", F.length("body").cast("long"))
    return box.select(
        "type", "n", *r6("q1", "median", "q3", "whisker_low", "whisker_high"), "outliers"
    )


def split_comparison(spark, d):
    table = pr.split_comparison(split_tickets(spark, d))
    return numbered(table.withColumn("share_overall", F.round("share_overall", 6)))


def split_drift(spark, d):
    drift = pr.split_drift(split_tickets(spark, d))
    return drift.withColumn("max_deviation", F.round("max_deviation", 6))


def imbalance(spark, d):
    table = wt.imbalance(category_counts(spark, d))
    return table.withColumn("imbalance_ratio", F.round("imbalance_ratio", 6))


def class_weights(spark, d):
    return wt.class_weights(category_counts(spark, d))


def weighted_rows(spark, d):
    rows = labelled(spark, d)
    weighted = wt.with_class_weight(rows, class_weights(spark, d))
    return weighted.select("ticket_id", "category", "weight")


def effective_distribution(spark, d):
    return wt.effective_distribution(class_weights(spark, d))


def majority_baseline(spark, d):
    return pr.majority_baseline(category_counts(spark, d)).select(*r6("majority_accuracy"))


PROFILED = ("subject", "body", "queue", "type", "tag_1", "priority", "language")
LENGTHS = "SELECT type, length(body) AS v FROM tickets WHERE body IS NOT NULL"
WORDS = f"SELECT *, len({sql_words('text')}) AS wc FROM labelled"
FILLED = (
    "SELECT category, coalesce(n, 0) AS n FROM dim LEFT JOIN class_counts USING (category)"
)
WEIGHTED = (
    "SELECT category, n, round_even(sum(n) OVER () / (count(*) OVER () * n), 4) AS balanced, "
    "least(round_even(sum(n) OVER () / (count(*) OVER () * n), 4), 4.0) AS capped, "
    + ", ".join(
        f"round_even((1 / e{i}) / avg(1 / e{i}) OVER (), 4) AS {name}"
        for i, (name, _) in enumerate(fv.EFFECTIVE_BETAS)
    )
    + " FROM (SELECT *, "
    + ", ".join(
        f"(1 - CAST({beta} AS DOUBLE) ** n) / (1 - CAST({beta} AS DOUBLE)) AS e{i}"
        for i, (_, beta) in enumerate(fv.EFFECTIVE_BETAS)
    )
    + " FROM filled)"
)
SCHEMES = ("balanced", "capped", *[n for n, _ in fv.EFFECTIVE_BETAS])

SKETCH_POINTS = (0.05, 0.25, 0.5, 0.75, 0.95)


def quantile_sketch(spark, d):
    """Prices hardly repeat: quantiles by flag from sketches of its line states, against the ranks among all rows."""
    rows, price = table(spark, d, "lineitem"), F.col("l_extendedprice")
    merged = qt.merge(qt.sketch(rows, price, ["l_returnflag", "l_linestatus"]), ["l_returnflag"])
    errors = qt.rank_errors(rows, price, SKETCH_POINTS, ["l_returnflag"], sketches=merged)
    return errors.select("l_returnflag", "point", "n", (F.col("error") <= qt.rank_error()).alias("within"))


QUERIES = {
    "quantile_sketch": (
        quantile_sketch,
        f"SELECT l_returnflag, unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in SKETCH_POINTS)}]) AS point, n, true AS within "
        "FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag)",
    ),
    "category_distribution": (
        lambda spark, d: pr.category_distribution(labelled(spark, d)),
        with_ctes("SELECT category, n FROM class_counts", "class_counts"),
    ),
    "value_counts": (
        value_counts,
        with_ctes(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM tickets "
                f"WHERE {c} IS NOT NULL GROUP BY {c}"
                for c in ("type", "priority", "language", "queue")
            ),
            "tickets",
        ),
    ),
    "column_profile": (
        column_profile,
        with_ctes(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, 'string' AS data_type, count(*) AS n_rows, "
                f"count({c}) AS non_null FROM tickets"
                for c in PROFILED
            ),
            "tickets",
        ),
    ),
    "distinct_types": (
        lambda spark, d: pr.distinct_values(tickets(spark, d), "type"),
        with_ctes("SELECT DISTINCT type FROM tickets", "tickets"),
    ),
    "describe_length": (
        describe_length,
        with_ctes(
            "SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, "
            "min(v) AS min, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, "
            f"quantile_cont(v, 0.75) AS p75, max(v) AS max FROM ({LENGTHS})",
            "tickets",
        ),
    ),
    "length_histogram": (
        length_histogram,
        with_ctes(
            "SELECT b.bin, round(lo + (b.bin - 1) * (hi - lo) / 50.0, 6) AS bin_from, "
            "round(lo + b.bin * (hi - lo) / 50.0, 6) AS bin_to, count(x.bin) AS n "
            "FROM (SELECT unnest(range(1, 51)) AS bin) b CROSS JOIN ends "
            "LEFT JOIN (SELECT least(50, floor(50 * CAST(v - lo AS DOUBLE) / (hi - lo)) + 1) AS bin "
            "FROM lengths, ends) x ON x.bin = b.bin GROUP BY b.bin, lo, hi",
            "tickets",
            lengths=LENGTHS,
            ends="SELECT min(v) AS lo, max(v) AS hi FROM lengths",
        ),
    ),
    "length_boxplot": (
        length_boxplot,
        with_ctes(
            "SELECT type, count(*) AS n, round(q1, 6) AS q1, round(m, 6) AS median, "
            "round(q3, 6) AS q3, round(least(min(v) FILTER (inside), q1), 6) AS whisker_low, "
            "round(greatest(max(v) FILTER (inside), q3), 6) AS whisker_high, "
            "count(*) FILTER (NOT inside) AS outliers FROM (SELECT *, "
            "v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside "
            "FROM lengths JOIN quartiles USING (type)) GROUP BY type, q1, m, q3",
            "tickets",
            lengths=LENGTHS,
            quartiles="SELECT type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS m, "
            "quantile_cont(v, 0.75) AS q3 FROM lengths GROUP BY type",
        ),
    ),
    "order_by_median": (
        lambda spark, d: pr.order_by_median(labelled(spark, d)),
        with_ctes(
            "SELECT category, median(wc) AS median_words FROM counted GROUP BY category",
            "labelled",
            counted=WORDS,
        ),
    ),
    "top_words": (
        top_words,
        with_ctes(
            "SELECT * FROM (SELECT type, word, n, row_number() OVER (PARTITION BY type "
            "ORDER BY n DESC, word) AS rank FROM (SELECT type, word, count(*) AS n FROM ("
            r"SELECT type, unnest(string_split_regex(lower(body), '[^\p{L}\p{N}_]+')) AS word "
            "FROM tickets) WHERE regexp_full_match(word, '[a-z]{3,}') GROUP BY ALL)) "
            "WHERE rank <= 12",
            "tickets",
        ),
    ),
    "crosstab_queue_type": (
        lambda spark, d: pr.crosstab(tickets(spark, d), "queue", "type", TYPES),
        with_ctes(
            "SELECT queue, "
            + ", ".join(f"count(*) FILTER (type = {q(t)}) AS \"{t}\"" for t in TYPES)
            + " FROM tickets WHERE queue IS NOT NULL GROUP BY queue ORDER BY queue LIMIT 10",
            "tickets",
        ),
    ),
    "distribution_zero_filled": (
        lambda spark, d: numbered(
            pr.distribution_zero_filled(labelled(spark, d).where(F.col("category") != "Billing"))
        ),
        with_ctes(
            "SELECT cat_no, category, CASE WHEN category = 'Billing' THEN 0 "
            "ELSE coalesce(n, 0) END AS n FROM dim LEFT JOIN class_counts USING (category)",
            "dim",
            "class_counts",
        ),
    ),
    "split_comparison": (
        split_comparison,
        with_ctes(
            "SELECT cat_no, category, count(split) AS overall, "
            "count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, "
            "count(*) FILTER (split = 'test') AS test, "
            "round(count(split) / sum(count(split)) OVER (), 6) AS share_overall "
            "FROM dim LEFT JOIN split_tickets USING (category) GROUP BY cat_no, category",
            "dim",
            "split_tickets",
        ),
    ),
    "split_drift": (
        split_drift,
        with_ctes(
            "SELECT round(max(gap), 6) AS max_deviation, max(gap) < 0.01 AS passed FROM ("
            "SELECT abs(n / sum(n) OVER (PARTITION BY split) - share) AS gap FROM ("
            "SELECT split, category, count(*) AS n FROM split_tickets GROUP BY ALL) "
            "JOIN (SELECT category, n / sum(n) OVER () AS share FROM class_counts) "
            "USING (category))",
            "split_tickets",
        ),
    ),
    "text_stats": (
        lambda spark, d: pr.text_stats(labelled(spark, d)),
        with_ctes(
            "SELECT category, count(*) AS n, round_even(avg(wc), 1) AS mean_words, "
            "round_even(median(wc), 1) AS median_words, "
            "round_even(quantile_cont(wc, 0.95), 1) AS p95_words FROM counted GROUP BY category",
            "labelled",
            counted=WORDS,
        ),
    ),
    "imbalance": (
        imbalance,
        with_ctes(
            "SELECT category, n, round_even(n / sum(n) OVER (), 4) AS share, "
            "round_even(sum(n) OVER () / (count(*) OVER () * n), 4) AS balanced_w, "
            "round(max(n) OVER () / min(n) OVER (), 6) AS imbalance_ratio FROM filled",
            "dim",
            "class_counts",
            filled=FILLED,
        ),
    ),
    "class_weights": (
        class_weights,
        with_ctes(WEIGHTED, "dim", "class_counts", filled=FILLED),
    ),
    "weighted_rows": (
        weighted_rows,
        with_ctes(
            "SELECT ticket_id, category, balanced AS weight FROM labelled JOIN weighted "
            "USING (category)",
            "dim",
            "class_counts",
            filled=FILLED,
            weighted=WEIGHTED,
        ),
    ),
    "effective_distribution": (
        effective_distribution,
        with_ctes(
            "SELECT scheme, category, round_even(m / sum(m) OVER (PARTITION BY scheme), 4) "
            "AS share FROM (SELECT 'raw' AS scheme, category, CAST(n AS DOUBLE) AS m "
            "FROM weighted UNION ALL "
            + " UNION ALL ".join(f"SELECT '{s}', category, {s} * n FROM weighted" for s in SCHEMES)
            + ")",
            "dim",
            "class_counts",
            filled=FILLED,
            weighted=WEIGHTED,
        ),
    ),
    "majority_baseline": (
        majority_baseline,
        with_ctes(
            "SELECT round(max(n) / sum(n), 6) AS majority_accuracy FROM class_counts",
            "class_counts",
        ),
    ),
    "prepare_summary": (
        lambda spark, d: pr.prepare_summary(split_tickets(spark, d)),
        with_ctes(
            "SELECT scope, category, count(*) AS n FROM (SELECT split AS scope, category "
            "FROM split_tickets UNION ALL SELECT 'all', category FROM split_tickets) "
            "GROUP BY GROUPING SETS ((scope, category), (scope))",
            "split_tickets",
        ),
    ),
}
