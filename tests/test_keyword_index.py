import random
import time

import pytest
from pyspark.sql import functions as F

from triage.operators import keyword_index as K
from triage.operators import label as lb

RULES = "rule_no long, category string, pattern string, note string"


def frame(spark, rules):
    return spark.createDataFrame([(*r, "x") for r in rules], RULES)


def loop(rules, text):
    """Every keyword tried on the text."""
    if text is None:
        return None
    own = [(n, c, p) for n, c, p in rules if c is not None and p is not None]
    rank = {c: min(n for n, d, _ in own if d == c) for _, c, _ in own}
    return min(((rank[c], c) for _, c, p in own if p in text), default=(0, None))[1]


def made(seed, n=400):
    rng = random.Random(seed)
    letters = "abcdeé日\U0001f600 "
    rules = [
        (i, f"c{rng.randrange(12)}", "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 4, 5, 6, 9]))))
        for i in range(n, 0, -1)
    ]
    rules = [r for r in rules if len(r[2]) > 3 or rng.random() < 0.05]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 30, 200]))) for _ in range(250)]
    return rules, [*texts, None, "", "zzz", texts[40], texts[40]]


@pytest.mark.parametrize("in_row_bytes", [K.IN_ROW_BYTES, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_trying_every_keyword(spark, in_row_bytes, seed):
    rules, texts = made(seed)
    index = K.keyword_index(frame(spark, rules), in_row_bytes)
    assert index.in_row == bool(in_row_bytes)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["found"] for r in index.with_category(df, "text", "found").collect()}
    assert got == {i: loop(rules, t) for i, t in enumerate(texts)}
    assert len({*got.values()}) > 5


@pytest.mark.parametrize("in_row_bytes", [K.IN_ROW_BYTES, 0])
def test_odd_rules(spark, in_row_bytes):
    df = spark.createDataFrame([(0, "abcd"), (1, ""), (2, None), (3, "x'\"\\y{}")], "id long, text string")
    for rules in (
        [],
        [(1, "a", None), (2, None, "b")],
        [(5, "all", ""), (7, "late", "ab"), (3, "first", "bcd")],
        [(1, "a", "abcd"), (1, "b", "abc"), (2, "a", "x'\"\\y"), (2, "a", "x'\"\\y")],
    ):
        index = K.keyword_index(frame(spark, rules), in_row_bytes)
        got = {r["id"]: r["category"] for r in index.with_category(df, "text").collect()}
        assert got == {i: loop(rules, t) for i, t in [(0, "abcd"), (1, ""), (2, None), (3, "x'\"\\y{}")]}, rules


def test_a_large_book_is_a_projection_without_python(spark):
    rules = [(i, f"c{i % 9}", f"key{i * 7919 % 100_003:06d}word") for i in range(50_000)]
    texts = [(i, f"some text with key{i * 7919 % 100_003:06d}word inside and more " + "of it " * 50) for i in range(0, 60_000, 100)]
    index = K.keyword_index(frame(spark, rules))
    df = spark.createDataFrame(texts, "id long, text string").repartition(4).cache()
    labelled = index.with_category(df, "text")
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Arrow" not in plan
    got = {r["id"]: r["category"] for r in labelled.collect()}
    assert got == {i: f"c{i % 9}" if i < 50_000 else None for i, _ in texts}


def test_cost_does_not_grow_with_the_rules(spark):
    text = " ".join(f"plain{i % 50}" for i in range(300))
    df = spark.createDataFrame([(i, text + str(i)) for i in range(1500)], "id long, text string").repartition(4).cache()
    df.count()

    def seconds(n):
        index = K.keyword_index(frame(spark, [(i, "c", f"rule{i:06d}") for i in range(n)]))
        labelled = index.with_category(df, "text").where("category is not null")
        labelled.count()
        start = time.time()
        labelled.count()
        return time.time() - start

    assert seconds(20_000) < 6 * seconds(200) + 3


def test_cost_does_not_grow_with_the_square_of_a_text(spark):
    rng = random.Random(3)
    index = K.keyword_index(frame(spark, [(i, f"c{i % 5}", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))) for i in range(40_000)]))

    def seconds(n, length):
        texts = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=length))) for i in range(n)]
        df = spark.createDataFrame(texts, "id long, text string").repartition(8).cache()
        labelled = index.with_category(df, "text").where("category is not null")
        labelled.count()
        start = time.time()
        labelled.count()
        return time.time() - start

    assert seconds(200, 40_000) < 4 * seconds(20_000, 400) + 3


def test_first_keyword_of_several_in_a_bucket_and_of_one_anchor(spark):
    """Keywords of one anchor, keywords at the same rank, and a keyword whose anchor is there without it."""
    words = ["abcdx", "abcdy", "abcdz", "zabcd", "ab", "a", "é日😀"]
    rules = [(n, f"c{n % 4}", w) for n, w in enumerate(words)] + [(2, "d", "abcdz"), (9, "all", "")]
    texts = ["abcd", "abcdz", "abcdy abcdx", "zabcdy", "b", "", "xé日😀", "ab", None, "é日"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for in_row_bytes in (K.IN_ROW_BYTES, 0):
        got = {r["id"]: r["category"] for r in K.keyword_index(frame(spark, rules), in_row_bytes).with_category(df, "text").collect()}
        assert got == {i: loop(rules, t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("in_row_bytes", [K.IN_ROW_BYTES, 0])
def test_labels_with_the_default_book_are_the_same(spark, in_row_bytes):
    from triage import fixed_values as fv
    from triage.fixtures import tickets

    rows = [(n, c, k) for n, (c, k) in enumerate((c, k) for c, ks in fv.KEYWORD_RULES for k in ks)]
    index = K.keyword_index(frame(spark, rows), in_row_bytes)
    raw = tickets(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    by_loop = lb.map_to_category(raw).select("ticket_id", "category", "label_source")
    by_index = lb.map_to_category(raw, keyword_rules=index).select("ticket_id", "category", "label_source")
    assert by_loop.exceptAll(by_index).count() == by_index.exceptAll(by_loop).count() == 0
    assert by_loop.where(F.col("label_source") == "keyword").count() > 10
