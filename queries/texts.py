"""Sources, text functions and rule labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import (
    documents,
    labelled,
    names,
    q,
    requests,
    split_tickets,
    sql_assemble,
    sql_clean,
    sql_emails,
    sql_html,
    sql_squeeze,
    sql_urls,
    sql_words,
    table,
    tickets,
    with_ctes,
)
from triage import fixed_values as fv
from triage.functions import text as tx
from triage.operators import label as lb
from triage.operators import triage_rules as tr
from triage.operators.growing_split import GrowingSplit
from triage.operators.keyword_index import keyword_index
from triage.operators.split import stratified_split
from triage.sources import tickets as src
from triage.sources.folders import work_folder


def scan_tickets(spark, d):
    raw = tickets(spark, d)
    return src.missing_as_null(raw).select(
        "ticket_id", "subject", "body", "queue", "type", "tag_1", "tag_2", "language"
    )


def union_sources(spark, d):
    docs = documents(spark, d).select("doc_id", "text", "lang")
    talk = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), "text", "role"
    )
    return src.union_sources(docs, talk)


def read_split(spark, d):
    path = work_folder(spark, "splits")
    src.write_splits(split_tickets(spark, d), path)
    return src.read_split(spark, path, "val")


def validate_tickets(spark, d):
    rows = requests(spark, d).withColumn(
        "customer_plan",
        F.when(F.col("ticket_id") % 6 == 0, F.lit(None))
        .when(F.col("ticket_id") % 19 == 0, F.lit("gold"))
        .otherwise(F.col("customer_plan")),
    )
    return tr.validate_tickets(rows).select(
        "ticket_id", "customer_plan", F.length("text").cast("long").alias("n_chars"), "reject_reason"
    )


def of_documents(function):
    return lambda spark, d: documents(spark, d).select("doc_id", function("text").alias("out"))


def remove_html(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", tx.remove_html("html").alias("out"))


def clean_text(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    pages = table(spark, d, "pages").select(
        (-F.col("page_id") - 1).alias("id"), F.col("html").alias("raw")
    )
    return docs.unionByName(pages).select("id", tx.clean_text("raw").alias("out"))


def clean_text_or_empty(spark, d):
    return tickets(spark, d).select("ticket_id", tx.clean_text_or_empty("body").alias("out"))


def word_tokens(spark, d):
    tokens = tx.word_tokens(tx.clean_text("text"))
    return documents(spark, d).select("doc_id", F.array_join(tokens, " ").alias("out"))


def rule_table(spark, d):
    """A rule book of all words of the benchmark's texts; a word's category goes by its length."""
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("pattern"))
    length = F.char_length("pattern")
    place = (length % len(fv.CATEGORIES) + 1).cast("int")
    return (
        words.where("pattern <> ''")
        .groupBy("pattern")
        .agg(F.min("item_id").alias("item"))
        .select(
            (F.col("item") * 100 + length).alias("rule_no"),
            F.element_at(F.array(*map(F.lit, fv.CATEGORIES)), place).alias("category"),
            "pattern",
        )
    )


RULE_TABLE_SQL = (
    "SELECT min(item_id) * 100 + length(pattern) AS rule_no, "
    f"list_extract([{names(fv.CATEGORIES)}], CAST(length(pattern) % {len(fv.CATEGORIES)} + 1 AS BIGINT)) AS category, pattern "
    "FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS pattern FROM benchmark) "
    "WHERE pattern <> '' GROUP BY pattern"
)


def label_by_rule_table(spark, d):
    rows = lb.with_rule_text(tickets(spark, d))
    index = keyword_index(rule_table(spark, d))
    return index.with_category(rows, "rule_text", "category").select("ticket_id", "category")


def label_by(kind):
    def run(spark, d):
        rows = lb.with_rule_text(tickets(spark, d))
        column = {
            "queue": lambda: lb.category_by_queue(F.col("queue")),
            "tag": lambda: lb.category_by_tag(F.col("tag_1")),
            "keyword": lambda: lb.category_by_keyword(F.col("rule_text")),
        }[kind]()
        return rows.select("ticket_id", column.alias("category"))

    return run


def map_to_category(spark, d):
    return lb.map_to_category(tickets(spark, d)).select("ticket_id", "category", "label_source")


def split_growing(spark, d):
    """All tickets, arriving in two batches of which one is sent again."""
    rows = labelled(spark, d)
    growing = GrowingSplit(spark, work_folder(spark, "growing-split"))
    short = F.length("text") < 500
    for batch, part in (("short", rows.where(short)), ("long", rows.where(~short)), ("short", rows.where(short))):
        growing.append(part, batch)
    return growing.label(rows).select("ticket_id", "category", "split")


def split_query(spark, d):
    return split_tickets(spark, d).select("ticket_id", "category", "split")


def split_pieces() -> str:
    return (
        "list_filter(string_split_regex(strip_accents(" + sql_clean("text")
        + r"), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 2)"
    )


def of_documents_sql(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS out FROM documents"


NA = ", ".join(q(x) for x in fv.NA_TEXT)
RAW = ("subject", "body", "queue", "type", "tag_1", "tag_2", "language")

QUERIES = {
    "scan_tickets": (
        scan_tickets,
        with_ctes(
            "SELECT ticket_id, "
            + ", ".join(f"CASE WHEN {c} NOT IN ({NA}) THEN {c} END AS {c}" for c in RAW)
            + " FROM tickets",
            "tickets",
        ),
    ),
    "union_sources": (
        union_sources,
        "SELECT doc_id, text, lang, NULL AS role FROM documents UNION ALL "
        "SELECT conv_id, text, NULL, role FROM conversations",
    ),
    "read_split": (
        read_split,
        with_ctes(
            "SELECT ticket_id, text, category FROM split_tickets WHERE split = 'val'",
            "split_tickets",
        ),
    ),
    "validate_tickets": (
        validate_tickets,
        with_ctes(
            "SELECT ticket_id, coalesce(plan, 'free') AS customer_plan, "
            "length(text) AS n_chars, CASE WHEN text IS NULL THEN 'text missing' "
            "WHEN length(text) < 1 THEN 'text too short' "
            "WHEN length(text) > 8000 THEN 'text too long' "
            f"WHEN plan NOT IN ({names(fv.PLANS)}) THEN 'unknown plan' END AS reject_reason "
            "FROM (SELECT *, CASE WHEN ticket_id % 6 = 0 THEN NULL "
            "WHEN ticket_id % 19 = 0 THEN 'gold' ELSE customer_plan END AS plan FROM requests)",
            "requests",
        ),
    ),
    "filter_language": (
        lambda spark, d: lb.filter_language(tickets(spark, d)).select("ticket_id", "language"),
        with_ctes("SELECT ticket_id, language FROM tickets WHERE language = 'en'", "tickets"),
    ),
    "assemble_text": (
        lambda spark, d: requests(spark, d).select("ticket_id", "text"),
        with_ctes(f"SELECT ticket_id, {sql_assemble()} AS text FROM tickets", "tickets"),
    ),
    "rule_text_blob": (
        lambda spark, d: lb.with_rule_text(tickets(spark, d)).select("ticket_id", "rule_text"),
        with_ctes("SELECT ticket_id, blob AS rule_text FROM blobs", "blobs"),
    ),
    "build_labeled": (labelled, with_ctes("SELECT * FROM labelled", "labelled")),
    "label_by_queue": (
        label_by("queue"),
        with_ctes("SELECT ticket_id, by_queue AS category FROM ruled", "ruled"),
    ),
    "label_by_tag": (
        label_by("tag"),
        with_ctes("SELECT ticket_id, by_tag AS category FROM ruled", "ruled"),
    ),
    "label_by_keyword": (
        label_by("keyword"),
        with_ctes("SELECT ticket_id, by_keyword AS category FROM ruled", "ruled"),
    ),
    "label_by_rule_table": (
        label_by_rule_table,
        with_ctes(
            "SELECT ticket_id, min_by(category, rank) AS category FROM blobs LEFT JOIN ranked ON contains(blob, pattern) "
            "GROUP BY ticket_id",
            "blobs",
            rules=RULE_TABLE_SQL,
            ranked="SELECT *, min(rule_no) OVER (PARTITION BY category) AS rank FROM rules",
        ),
    ),
    "map_to_category": (
        map_to_category,
        with_ctes("SELECT ticket_id, category, label_source FROM mapped", "mapped"),
    ),
    "label_source_profile": (
        lambda spark, d: lb.label_source_profile(tickets(spark, d)),
        with_ctes(
            "SELECT label_source, category, count(*) AS n FROM mapped GROUP BY ALL", "mapped"
        ),
    ),
    "remove_html": (remove_html, f"SELECT page_id, {sql_html('html')} AS out FROM pages"),
    "remove_urls": (of_documents(tx.remove_urls), of_documents_sql(sql_urls("text"))),
    "remove_emails": (of_documents(tx.remove_emails), of_documents_sql(sql_emails("text"))),
    "normalize_whitespace": (
        of_documents(tx.normalize_whitespace),
        of_documents_sql(sql_squeeze("text")),
    ),
    "clean_text": (
        clean_text,
        f"SELECT id, {sql_clean('raw')} AS out FROM (SELECT doc_id AS id, text AS raw "
        "FROM documents UNION ALL SELECT -page_id - 1, html FROM pages)",
    ),
    "clean_text_or_empty": (
        clean_text_or_empty,
        with_ctes(
            f"SELECT ticket_id, coalesce({sql_clean('body')}, '') AS out FROM tickets", "tickets"
        ),
    ),
    "word_count": (
        of_documents(tx.word_count),
        of_documents_sql(f"CAST(len({sql_words('text')}) AS INTEGER)"),
    ),
    "body_length": (
        of_documents(F.length),
        of_documents_sql("CAST(length(text) AS INTEGER)"),
    ),
    "word_tokens": (
        word_tokens,
        of_documents_sql(f"array_to_string({split_pieces()}, ' ')"),
    ),
    "stratified_split": (
        split_query,
        with_ctes("SELECT ticket_id, category, split FROM split_tickets", "split_tickets"),
    ),
    "split_growing": (
        split_growing,
        with_ctes("SELECT ticket_id, category, split FROM split_tickets", "split_tickets"),
    ),
}
