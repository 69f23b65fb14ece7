"""Tables and shared SQL of the registered queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage import fixtures
from triage.functions import text as tx
from triage.operators import label as lb
from triage.operators import split as sp

# --- Spark side -------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.tickets(documents(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with the assembled text a request would carry."""
    return tickets(spark, sf_dir).withColumn("text", tx.assemble_text("subject", "body"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.build_labeled(tickets(spark, sf_dir))


def split_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.stratified_split(labelled(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule label as truth, the subject's keywords as prediction, a made-up confidence."""
    guess = lb.category_by_keyword(F.lower(F.coalesce("subject", F.lit(""))))
    return (
        lb.keep_labelled(tickets(spark, sf_dir).withColumn("_guess", guess))
        .select(
            "ticket_id",
            F.when(F.col("ticket_id") % 2 == 0, "val").otherwise("test").alias("split"),
            F.col("category").alias("y_true"),
            F.coalesce("_guess", F.lit("Bug Report")).alias("y_pred"),
            ((F.col("ticket_id") * 7919) % 1000 / F.lit(999.0)).alias("conf"),
        )
    )


# --- SQL side ------------------------------------------------------------------------

SP = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NSP = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
EMAIL = r"[\p{L}\p{N}_][\p{L}\p{N}_.-]*@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(q(v) for v in values)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def sql_html(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def sql_urls(x: str) -> str:
    return rf"regexp_replace({x}, 'https?://{NSP}+|www\.{NSP}+', ' ', 'g')"


def sql_emails(x: str) -> str:
    return f"regexp_replace({x}, '{EMAIL}', ' ', 'g')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


def sql_clean(x: str) -> str:
    return sql_squeeze(sql_emails(sql_urls(sql_html(f"lower({x})"))))


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SP}+'), lambda w: w <> '')"


def sql_assemble() -> str:
    parts = [sql_strip(f"coalesce({c}, '')") for c in ("subject", "body")]
    return sql_strip(f"{parts[0]} || chr(10) || chr(10) || {parts[1]}")


def sql_blob() -> str:
    fields = ", ".join(f"lower(nullif({c}, ''))" for c in fv.RULE_TEXT_COLUMNS)
    return f"concat_ws(' ' || chr(10) || ' ', {fields})"


def sql_keyword(blob: str) -> str:
    whens = [
        f"WHEN {' OR '.join(f'contains({blob}, {q(k)})' for k in kws)} THEN {q(cat)}"
        for cat, kws in fv.KEYWORD_RULES
    ]
    return f"CASE {' '.join(whens)} END"


def sql_queue() -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.QUEUE_CATEGORY.items())
    return f"CASE queue {whens} END"


def sql_tag() -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.TAG_CATEGORY.items())
    return f"CASE lower({sql_strip('tag_1')}) {whens} END"


CTES = {
    "tickets": fixtures.TICKETS_SQL.format(documents="documents"),
    "requests": f"SELECT *, {sql_assemble()} AS text FROM tickets",
    "blobs": f"SELECT *, {sql_blob()} AS blob FROM tickets",
    "ruled": (
        f"SELECT *, {sql_queue()} AS by_queue, {sql_tag()} AS by_tag, "
        f"{sql_keyword('blob')} AS by_keyword FROM blobs"
    ),
    "mapped": (
        "SELECT *, coalesce(by_queue, by_tag, by_keyword) AS category, "
        "CASE WHEN by_queue IS NOT NULL THEN 'queue' WHEN by_tag IS NOT NULL THEN 'tag' "
        "WHEN by_keyword IS NOT NULL THEN 'keyword' END AS label_source FROM ruled"
    ),
    "labelled": (
        f"SELECT * FROM (SELECT ticket_id, {sql_assemble()} AS text, category FROM mapped "
        "WHERE language = 'en' AND category IS NOT NULL) WHERE length(text) > 0"
    ),
    "class_counts": "SELECT category, count(*) AS n FROM labelled GROUP BY category",
    "dim": "SELECT unnest(range({n})) AS cat_no, unnest([{cats}]) AS category".format(
        n=len(fv.CATEGORIES), cats=names(fv.CATEGORIES)
    ),
    # Quotas: test first, then validation of the rest, by largest remainder.
    "test_quota": (
        "SELECT category, n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, category) "
        "<= total - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM ("
        "SELECT category, n, total, (n * total) // everything AS fl, (n * total) % everything AS rem "
        "FROM (SELECT category, n, sum(n) OVER () AS everything, "
        "(sum(n) OVER () * 3 + 19) // 20 AS total FROM class_counts))"
    ),
    "quota": (
        "SELECT category, n, n_test, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, "
        "category) <= total - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_val FROM ("
        "SELECT category, n, n_test, total, (rest * total) // everything AS fl, "
        "(rest * total) % everything AS rem FROM (SELECT category, n, n_test, n - n_test AS rest, "
        "sum(n - n_test) OVER () AS everything, (sum(n - n_test) OVER () * 3 + 16) // 17 AS total "
        "FROM test_quota))"
    ),
    "split_tickets": (
        "SELECT ticket_id, text, category, CASE WHEN rank <= n_test THEN 'test' "
        "WHEN rank <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM ("
        "SELECT l.*, n_test, n_val, row_number() OVER (PARTITION BY l.category "
        "ORDER BY md5('42|' || CAST(ticket_id AS VARCHAR))) AS rank "
        "FROM labelled l JOIN quota USING (category))"
    ),
    "predictions": (
        "SELECT ticket_id, CASE WHEN ticket_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, "
        "category AS y_true, coalesce({guess}, 'Bug Report') AS y_pred, "
        "(ticket_id * 7919) % 1000 / CAST(999.0 AS DOUBLE) AS conf FROM mapped "
        "WHERE category IS NOT NULL"
    ).format(guess=sql_keyword("lower(coalesce(subject, ''))")),
}

NEEDS = {
    "requests": ["tickets"],
    "blobs": ["tickets"],
    "ruled": ["blobs"],
    "mapped": ["ruled"],
    "labelled": ["mapped"],
    "class_counts": ["labelled"],
    "test_quota": ["class_counts"],
    "quota": ["test_quota"],
    "split_tickets": ["quota", "labelled"],
    "predictions": ["mapped"],
}


def with_ctes(body: str, *wanted: str, **extra: str) -> str:
    """``body`` after the named shared CTEs, what they need, and ``extra`` ones."""

    def need(done: list[str], name: str) -> list[str]:
        if name in done:
            return done
        return [*reduce(need, NEEDS.get(name, []), done), name]

    order = reduce(need, wanted, [])
    parts = [f"{n} AS ({CTES[n]})" for n in order]
    parts += [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
