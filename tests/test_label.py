import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage.operators import label as lb

SCHEMA = (
    "ticket_id long, subject string, body string, queue string, type string, tag_1 string, "
    "tag_2 string, tag_3 string, tag_4 string, language string"
)


def row(i=0, subject=None, body=None, queue=None, tag=None, tag_2=None, language="en"):
    return (i, subject, body, queue, "Incident", tag, tag_2, None, None, language)


CASES = [
    (row(0, "Everything crashes", "bad bug", queue="Billing and Payments"), "Billing", "queue"),
    (row(1, "Crash", queue="billing and payments"), "Bug Report", "keyword"),
    (row(2, "hey", tag="Login"), "Authentication", "tag"),
    (row(3, "hey", tag="  REFUND "), "Billing", "tag"),
    (row(4, "Two charges on my card", "was charged two times"), "Billing", "keyword"),
    (row(5, "Cannot get in", "forgot password, no link arrives"), "Authentication", "keyword"),
    (row(6, "All frozen", "the thing is broken, stack trace below"), "Bug Report", "keyword"),
    (row(7, "Idea", "would love if there was a light mode"), "Feature Request", "keyword"),
    (row(8, "Question", "where can i find the docker files"), "Technical Setup", "keyword"),
    (row(9, "Hi all,", "what a lovely day", queue="General Inquiry", tag="Feedback"), None, None),
    (row(10, "We shall integrate"), None, None),
    (row(11, "We shall integrate", "soon"), "Feature Request", "keyword"),
    (row(12, "carbon footprint"), "Authentication", "keyword"),
    (row(13, None, None, tag=""), None, None),
    (row(14, "nothing", tag_2="Outage"), "Bug Report", "keyword"),
]


def test_map_to_category(spark):
    df = spark.createDataFrame([c[0] for c in CASES], SCHEMA)
    got = {r["ticket_id"]: (r["category"], r["label_source"])
           for r in lb.map_to_category(df).collect()}
    assert got == {c[0][0]: (c[1], c[2]) for c in CASES}
    kept = {r["ticket_id"] for r in lb.keep_labelled(df).collect()}
    assert kept == {c[0][0] for c in CASES if c[1]}


def test_missing_columns_count_as_null(spark):
    df = spark.createDataFrame([("Refund dispute", "money back")], "subject string, body string")
    assert lb.map_to_category(df).first()["category"] == "Billing"


def test_build_labeled(spark):
    rows = [
        row(1, " Refund ", "\nplease"),
        row(2, "Refund", "bitte", language="de"),
        row(3, "lovely"),
        row(4, "  ", None, queue="Billing and Payments"),
        row(5, "Refund", language="EN"),
        row(6, None, "refund", language=None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lb.build_labeled(df).collect()
    assert [tuple(r) for r in got] == [(1, "Refund\n\nplease", "Billing")]
    everything = {r["ticket_id"] for r in lb.build_labeled(df, english_only=False).collect()}
    assert everything == {1, 2, 5, 6}
    with pytest.raises(ValueError, match="tag_1"):
        lb.build_labeled(df.drop("tag_1"))


def test_every_keyword_fires_for_its_category_or_an_earlier_one(spark):
    order = list(fv.CATEGORIES)
    pairs = [(c, k) for c, ks in fv.KEYWORD_RULES for k in ks]
    assert [len(ks) for _, ks in fv.KEYWORD_RULES] == [54, 48, 53, 29, 35]
    df = spark.createDataFrame(pairs, "own string, text string")
    for r in df.select("own", lb.category_by_keyword(F.col("text")).alias("got")).collect():
        assert order.index(r["got"]) <= order.index(r["own"])


def test_shortest_keywords_keep_the_meaning():
    assert lb.shortest_keywords(["bill", "billing", "pay"]) == ["bill", "pay"]


def python_label(blob, rules):
    return next((c for c, ks in rules if any(k in blob for k in ks)), None)


FRAGMENTS = st.sampled_from(
    [k for _, ks in fv.KEYWORD_RULES for k in ks] + ["x", " ", "in", "ing", "the ", "\n", "s"]
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(FRAGMENTS, max_size=3).map("".join), min_size=60, max_size=90))
def test_keyword_rule_equals_the_python_rule(apply, values):
    got = apply(lambda c: lb.category_by_keyword(F.col(c)), values)
    assert got == [python_label(v, fv.KEYWORD_RULES) for v in values]


def test_rules_from_a_table(spark, apply):
    table = spark.createDataFrame(
        [(2, "B", "dog"), (1, "A", "cat"), (3, "A", "cow")],
        "rule_no int, category string, pattern string",
    )
    rules = lb.rules_from_frame(table)
    assert rules == [("A", ["cat", "cow"]), ("B", ["dog"])]
    got = apply(lambda c: lb.category_by_keyword(F.col(c), rules), ["a dog, a cow", "dogs", "hen"])
    assert got == ["A", "B", None]


def test_thousands_of_rules(apply):
    rules = [("A", [f"code-{i:05d}!" for i in range(5000)]), ("B", ["code"])]
    got = apply(lambda c: lb.category_by_keyword(F.col(c), rules), ["code-04999!", "code-1", "-"])
    assert got == ["A", "B", None]
