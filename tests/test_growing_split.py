import pytest
from pyspark.sql import functions as F

from triage.operators import split as sp
from triage.operators.growing_split import GrowingSplit

CATEGORIES = ["a", "b", None, "rare"]


def rows(spark, first, last):
    """Tickets of some categories, one of which has few, and one no name."""
    data = [(i, CATEGORIES[3] if i % 97 == 0 else CATEGORIES[i * i % 3]) for i in range(first, last)]
    return spark.createDataFrame(data, "ticket_id long, category string")


def sets(df):
    return {(r["ticket_id"], r["category"]): r["split"] for r in df.collect()}


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    growing = GrowingSplit(spark, str(tmp_path_factory.mktemp("growing")))
    growing.append(rows(spark, 0, 600), "monday")
    before = growing.boundaries().collect()
    growing.append(rows(spark, 600, 1000), "tuesday")
    return growing, spark.createDataFrame(before, "category string, last_test string, last_val string")


def test_equals_a_split_of_the_whole(spark, grown):
    whole = rows(spark, 0, 1000)
    assert sets(grown[0].label(whole)) == sets(sp.stratified_split(whole))


def test_boundaries_before_are_those_of_the_first_batch(spark, grown):
    growing, before = grown
    first = rows(spark, 0, 600)
    assert sets(growing.label(first, before)) == sets(sp.stratified_split(first))


def test_moved_tickets_are_those_whose_set_differs(spark, grown):
    growing, before = grown
    first = rows(spark, 0, 600)
    was, now = sets(growing.label(first, before)), sets(growing.label(first))
    wanted = {(str(i), c): (was[i, c], now[i, c]) for i, c in was if was[i, c] != now[i, c]}
    got = {(r["ticket_id"], r["category"]): (r["was"], r["now"]) for r in growing.moved(before, ["monday"]).collect()}
    assert got == wanted
    assert wanted


def test_a_repeated_batch_changes_nothing(spark, grown):
    growing, _ = grown
    counted = growing.counts().agg(F.sum("in_bucket")).first()[0]
    assert not growing.append(rows(spark, 600, 1000), "tuesday")
    assert growing.counts().agg(F.sum("in_bucket")).first()[0] == counted == 1000


def test_a_batch_without_counts_is_not_there(spark, grown, tmp_path):
    growing = GrowingSplit(spark, str(tmp_path))
    growing.append(rows(spark, 0, 300), "whole")
    half = rows(spark, 300, 500).select(
        F.col("category"), F.col("ticket_id").cast("string"), F.lit("0").alias("h"), F.lit("0").alias("prefix")
    )
    half.write.parquet(growing._hashes("half"))
    first = rows(spark, 0, 300)
    assert sets(growing.label(first)) == sets(sp.stratified_split(first))
    assert growing.append(rows(spark, 300, 500), "half")
    both = rows(spark, 0, 500)
    assert sets(growing.label(both)) == sets(sp.stratified_split(both))


def test_only_named_prefixes_of_the_hashes_are_read(grown):
    plan = grown[0].boundaries()._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/hashes/" in line]
    assert scans and all("PushedFilters: [Or" in line and "EqualTo(prefix" in line for line in scans)


def test_ways_for_many_categories_give_the_same(spark, grown, monkeypatch):
    growing, before = grown
    ends, moved = set(growing.boundaries().collect()), set(growing.moved(before, ["monday"]).collect())
    monkeypatch.setattr("triage.operators.growing_split.MOST_RANGES", 1)
    assert set(growing.boundaries().collect()) == ends
    assert set(growing.moved(before, ["monday"]).collect()) == moved


def test_nothing_appended(spark, tmp_path):
    growing = GrowingSplit(spark, str(tmp_path))
    assert growing.boundaries().count() == 0
    assert {s for s in sets(growing.label(rows(spark, 0, 10))).values()} == {"train"}


def test_batch_ids_are_file_names(spark, tmp_path):
    with pytest.raises(ValueError):
        GrowingSplit(spark, str(tmp_path)).append(rows(spark, 0, 3), "a/b")
