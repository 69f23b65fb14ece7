import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from triage.operators.report import recent_tickets, ticket_stats
from triage.sources.store import PredictionStore

SCHEMA = "ticket_id string, category string, sentiment string, priority string, routed_to string, created_at timestamp"


def tickets(spark, ids, day=1):
    rows = [
        (
            f"t{i:04d}", ["a", "b", None][i % 3], ["x", "y"][i % 2], "P1", "team",
            None if i % 11 == 0 else dt.datetime(2024, 1, day + i % 9, i % 24, 5),
        )
        for i in ids
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return PredictionStore(spark, str(tmp_path / "store"), spark.createDataFrame([], SCHEMA).schema)


def ids(df):
    return sorted(r["ticket_id"] for r in df.select("ticket_id").collect())


def same_answers(store, every):
    assert ids(store.read()) == ids(every)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(store.stats()) == rows(ticket_stats(every))
    for n in (0, 1, 7, 30, 10_000):
        assert list(map(tuple, store.recent(n).collect())) == list(map(tuple, recent_tickets(every, n).select(*store.schema.names).collect())), n


def test_empty_store(store, spark):
    same_answers(store, spark.createDataFrame([], SCHEMA))
    assert store.batches() == [] and store.compact() is False and store.vacuum() == []


def test_a_batch_counts_once(spark, store):
    first, second = tickets(spark, range(60)), tickets(spark, range(60, 100), day=9)
    assert store.append(first, "one") and store.append(second, "two")
    assert not store.append(first, "one") and not store.append(second, "one")
    assert store.append(first.limit(0), "nothing")
    assert store.batches() == ["nothing", "one", "two"]
    same_answers(store, first.unionByName(second))


@pytest.mark.parametrize("step", ["tickets", "counts", "record"])
def test_a_failure_on_the_way_leaves_nothing(spark, store, monkeypatch, step):
    first, second = tickets(spark, range(30)), tickets(spark, range(30, 70))
    store.append(first, "one")
    if step == "tickets":
        bad = second.withColumn("category", F.raise_error(F.lit("lost")).cast("string"))
        with pytest.raises(Exception, match="lost"):
            store.append(bad, "two")
    else:
        name = {"counts": "ticket_stats", "record": None}[step]
        with monkeypatch.context() as m:
            if name:
                m.setattr("triage.sources.store.ticket_stats", lambda *a: 1 / 0)
            else:
                m.setattr(PredictionStore, "_commit", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                store.append(second, "two")
    same_answers(store, first)
    assert store.append(second, "two")
    same_answers(store, first.unionByName(second))


def test_compaction_changes_no_answer(spark, store):
    parts = [tickets(spark, range(i, 120, 4)) for i in range(4)]
    for i, p in enumerate(parts[:3]):
        store.append(p, str(i))
    assert store.compact() and not store.compact()
    assert not store.append(parts[1], "1")
    assert store.append(parts[3], "3")
    every = tickets(spark, range(120))
    same_answers(store, every)
    assert len(store.vacuum()) == 3
    same_answers(store, every)
    assert store.compact()
    same_answers(store, every)


def test_of_two_writers_of_a_batch_one_wins(spark, store):
    rows, won = tickets(spark, range(40)), []
    threads = [threading.Thread(target=lambda: won.append(store.append(rows, "same"))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False, False, True]
    same_answers(store, rows)


def test_recent_reads_the_newest_days_only(spark, store):
    old, new = tickets(spark, range(0, 90), day=1), tickets(spark, range(1000, 1020), day=20)
    store.append(old, "old")
    store.append(new, "new")
    found = store.recent(5)
    assert list(map(tuple, found.collect())) == list(map(tuple, recent_tickets(old.unionByName(new), 5).collect()))
    files = {f.split("_day=")[1].split("/")[0] for f in found.inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_day" in plan and "2024-01-2" in plan
    assert all(d >= "2024-01-20" or d.startswith("__HIVE") for d in files), files


def test_days_do_not_hang_on_the_time_zone(spark, store):
    rows = tickets(spark, range(50))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        store.append(rows.where("ticket_id < 't0025'"), "one")
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        store.append(rows.where("ticket_id >= 't0025'"), "two")
        same_answers(store, rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_time_stamps_without_a_zone(spark, tmp_path):
    rows = tickets(spark, range(30)).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    store = PredictionStore(spark, str(tmp_path / "store"), rows.schema)
    store.append(rows, "one")
    same_answers(store, rows)


def test_stream_into_a_store(spark, store, tmp_path):
    from triage.plans.classify import classify
    from triage.streaming import online

    rows = [(f"t{i}", "Refund please, this is urgent" if i % 2 else "cannot log in", "free", dt.datetime(2024, 1, 1 + i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "ticket_id string, text string, customer_plan string, created_at timestamp")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    classified = classify(df, keep=("created_at",))
    own = PredictionStore(spark, str(tmp_path / "own"), classified.schema)

    def run(progress):
        arriving = online.read_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
        online.store_stream(arriving, own, str(tmp_path / progress)).awaitTermination()

    run("progress")
    assert len(own.batches()) == 4
    run("lost-progress")  # the same batches again, as after a failure
    same_answers(own, classified)


def test_files_do_not_grow_with_the_tasks_that_bring_tickets(spark, store, tmp_path):
    every = tickets(spark, range(400)).repartition(40)
    store.append(every, "one")
    same_answers(store, every)
    files = list((tmp_path / "store" / "tickets").glob("folder=*/_day=*/*.parquet"))
    days = {f.parent.name for f in files}
    assert len(days) > 1 and len(files) <= 2 * len(days)
