import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_model import CORPUS, table
from triage import fixed_values as fv
from triage.operators import model as mo
from triage.operators import report as rp
from triage.operators import triage_rules as tr
from triage.plans import jobs
from triage.plans.classify import OUTPUT, classify
from triage.sources import folders
from triage.sources import tickets as src
from triage.streaming import online

DATA = Path(__file__).parent / "data"


def test_read_raw_csv(spark):
    raw = src.read_raw_csv(spark, str(DATA / "raw_small.csv"))
    rows = raw.collect()
    assert len(rows) == 12
    assert rows[0]["body"] == (
        'Dear team,\nthe invoice shows "two" items, not one.\nBye'
    )
    assert rows[1]["tag_2"] is None and rows[3]["tag_1"] is None
    assert rows[5]["subject"] is None and rows[5]["body"] is None
    assert rows[10]["body"] == '""'
    assert "tag_4" in raw.columns and rows[0]["tag_4"] is None


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("subject,body\na,b\n")
    with pytest.raises(ValueError, match="queue"):
        src.read_raw_csv(spark, str(tmp_path / "bad.csv"))


def test_union_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(1, "y")], "a int, c string")
    assert src.union_sources(a, a, b).count() == 3
    assert src.union_sources(a, b).columns == ["a", "b", "c"]


def test_raw_round_trip_and_prepare(spark, tmp_path):
    raw = src.raw_to_parquet(spark, str(DATA / "raw_small.csv"), str(tmp_path / "raw"))
    assert raw.count() == 12
    summary = jobs.prepare(raw, str(tmp_path / "splits"))
    sizes = {r["scope"]: r["n"] for r in summary.where("category IS NULL").collect()}
    # Dropped: the German row, the empty one and the one without a language.
    assert sizes["all"] == 9 == sum(n for s, n in sizes.items() if s != "all")
    again = jobs.prepare(raw, str(tmp_path / "splits2"))
    assert sorted(map(str, again.collect())) == sorted(map(str, summary.collect()))
    val = src.read_split(spark, str(tmp_path / "splits"), "val")
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    ids = jobs.with_ids(raw)
    assert ids.select("ticket_id").distinct().count() == 12
    assert jobs.with_ids(ids) is ids


def test_train_job(spark, tmp_path):
    rows = [(t, c) for c, ts in CORPUS.items() for t in ts]
    df = table(spark, rows * 2).withColumn(
        "split", F.when(F.col("ticket_id") < 25, "train").otherwise("val")
    )
    src.write_splits(df, str(tmp_path / "splits"))
    overall = jobs.train(
        spark, str(tmp_path / "splits"), str(tmp_path / "model"), str(tmp_path / "metrics")
    )
    assert {r["split"]: r["accuracy"] for r in overall.collect()} == {"train": 1.0, "val": 1.0}
    assert spark.read.parquet(str(tmp_path / "metrics" / "report")).count() == 16
    doc = [json.loads(x) for f in (tmp_path / "metrics" / "document").glob("*.json")
           for x in f.open()]
    assert {d["split"] for d in doc} == {"train", "val"}
    model = mo.TopicModel.load(spark, str(tmp_path / "model"))
    out = classify(df.withColumn("customer_plan", F.lit("pro")), mode="model", model=model)
    assert out.columns == list(OUTPUT) and out.count() == 50
    assert out.select(F.sum("category_confidence")).first()[0] > 15


def requests(spark, rows):
    return spark.createDataFrame(rows, "ticket_id string, text string, customer_plan string")


def edge_tickets(spark):
    lines = [json.loads(x) for x in (DATA / "edge_tickets.jsonl").open(encoding="utf-8")]
    return lines, spark.createDataFrame(
        [(x["ticket_id"], x["text"], x.get("customer_plan")) for x in lines],
        "ticket_id string, text string, customer_plan string",
    )


def test_validation(spark):
    rows = [("1", "x", None), ("2", "", "pro"), ("3", None, "pro"), ("4", "y" * 8000, "free"),
            ("5", "y" * 8001, "free"), ("6", "z", "gold"), ("7", "z", "enterprise")]
    checked = tr.validate_tickets(requests(spark, rows))
    got = {r["ticket_id"]: r["reject_reason"] for r in checked.collect()}
    assert got == {"1": None, "2": "text too short", "3": "text missing", "4": None,
                   "5": "text too long", "6": "unknown plan", "7": None}
    assert tr.accepted(checked).count() + tr.rejected(checked).count() == len(rows)
    assert tr.accepted(checked).where("ticket_id = '1'").first()["customer_plan"] == "free"


def test_priority(spark):
    df = spark.createDataFrame(
        [(2, 0.78, "pro", 0.94), (0, 0.0, "free", 0.0), (9, 1.0, "enterprise", 1.0),
         (1, 0.0, "free", 0.0), (0, 0.5, "nonsense", 0.5), (1, 0.3, "enterprise", 0.1)],
        "hits int, intensity double, plan string, conf double",
    )
    score = tr.priority_score(F.col("hits"), F.col("intensity"), F.col("plan"), F.col("conf"))
    got = [(round(r[0], 6), r[1]) for r in df.select(score, tr.priority_level(score)).collect()]
    assert got == [(82.8, "P1"), (0.0, "P3"), (100.0, "P1"), (40.0, "P2"), (20.0, "P3"),
                   (70.0, "P1")]


def test_routing(spark):
    df = spark.createDataFrame([(c,) for c in (*fv.CATEGORIES, "New", None)], "category string")
    want = {**fv.TEAM_OF_CATEGORY, "New": "support-team", None: "support-team"}
    assert {r[0]: r[1] for r in tr.route_tickets(df).collect()} == want
    teams = spark.createDataFrame([("New", "new-team")], "category string, team string")
    got = {r["category"]: r["routed_to"] for r in tr.route_tickets(df, teams).collect()}
    assert got["New"] == "new-team" and got["Billing"] == got[None] == "support-team"


def test_classify_rules_on_requests(spark):
    out = classify(requests(spark, [
        (None, "Charged twice for my subscription! Unacceptable!", "pro"),
        ("b", "lovely weather", None),
        ("c", "", "pro"),
    ]))
    assert out.columns == list(OUTPUT)
    rows = {r["ticket_id"]: r for r in out.collect()}
    assert len(rows) == 2
    first = next(r for k, r in rows.items() if k.startswith("tkt_"))
    assert len(first["ticket_id"]) == 36
    assert (first["category"], first["sentiment"], first["routed_to"]) == (
        "Billing", "Angry", "billing-team"
    )
    assert first["urgency_signals"] == ["charged twice", "unacceptable"]
    assert first["priority"] in ("P1", "P2") and 0 <= first["priority_score"] <= 100
    assert rows["b"]["category"] is None and rows["b"]["category_confidence"] == 0.0
    with pytest.raises(ValueError):
        classify(requests(spark, []), mode="model")


def test_copies_without_ids_stay_whole(spark):
    model = mo.fit_topics(table(spark, [(t, c) for c, ts in CORPUS.items() for t in ts]))
    rows = [(None, "I paid the invoice twice", "pro")] * 7 + [(None, "app crashes", None)]
    out = classify(requests(spark, rows), mode="model", model=model)
    assert sorted(r["category"] for r in out.collect()) == ["Billing"] * 7 + ["Bug Report"]


def test_edge_tickets(spark):
    lines, df = edge_tickets(spark)
    assert len(lines) == 30
    got = {r["ticket_id"]: r for r in classify(df, max_chars=8000).collect()}
    for x in lines:
        if x["valid"]:
            r = got[x["ticket_id"]]
            assert r["category"] == x["category"], x
            assert r["urgency_signals"] == x["signals"], x
        else:
            assert x["ticket_id"] not in got


def test_stats_and_recent(spark):
    df = spark.createDataFrame(
        [("1", "Billing", "Angry", "P1", "billing-team", 5), ("2", None, "Angry", "P3", "x", 9),
         ("3", "Billing", "Neutral", "P3", "billing-team", 9)],
        "ticket_id string, category string, sentiment string, priority string, "
        "routed_to string, created_at int",
    )
    stats = {(r[0], r[1]): r[2] for r in rp.ticket_stats(df).collect()}
    assert stats["category", "Billing"] == 2 and stats["sentiment", "Angry"] == 2
    assert len(stats) == 7
    assert [r[0] for r in rp.recent_tickets(df, 2).collect()] == ["2", "3"]
    plan = rp.recent_tickets(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_append_predictions(spark, tmp_path):
    out = classify(requests(spark, [("a", "refund", None)])).withColumn(
        "created_at", F.to_timestamp(F.lit("2024-05-06 07:08:09"))
    )
    for _ in range(2):
        src.append_predictions(out, str(tmp_path / "store"))
    store = spark.read.parquet(str(tmp_path / "store"))
    assert store.count() == 2 and str(store.first()["date"]) == "2024-05-06"


def wait(query):
    assert query.awaitTermination(120)


def by_id(df):
    return {r["ticket_id"]: r for r in df.collect()}


def test_stream_equals_batch_and_goes_on_where_it_stopped(spark, tmp_path):
    _, df = edge_tickets(spark)
    inbox, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    first, second = df.where("ticket_id < 'e15'"), df.where("ticket_id >= 'e15'")
    for part in (first, second):
        part.coalesce(1).write.mode("append").json(inbox)
        arriving = online.read_stream(spark, inbox, df.schema, format="json", files_per_batch=1)
        wait(online.classify_stream(arriving, out, progress))
    got = spark.read.parquet(out)
    assert got.count() == classify(df).count()
    assert by_id(got) == by_id(classify(df))

    stats = str(tmp_path / "stats")
    arriving = online.read_stream(spark, inbox, df.schema, format="json")
    wait(online.stats_stream(classify(arriving), stats, str(tmp_path / "p2")))
    want = {(r[0], r[1]): r[2] for r in rp.ticket_stats(classify(df)).collect()}
    assert {(r[0], r[1]): r[2] for r in online.read_stats(spark, stats).collect()} == want


def test_stream_with_a_model(spark, tmp_path):
    model = mo.fit_topics(table(spark, [(t, c) for c, ts in CORPUS.items() for t in ts]))
    _, df = edge_tickets(spark)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(inbox)
    arriving = online.read_stream(spark, inbox, df.schema)
    wait(online.classify_stream(arriving, out, str(tmp_path / "p"), model=model))
    got = by_id(online.read_classified(spark, out))
    want = by_id(classify(df, mode="model", model=model))
    assert {k: r["category"] for k, r in got.items()} == {
        k: r["category"] for k, r in want.items()
    }


def test_work_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = folders.work_folder(spark, "x")
    assert not root or path.startswith(root)
    assert folders.work_folder(spark, "x") != path
