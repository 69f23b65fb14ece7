import random

import numpy as np
from pyspark.sql import functions as F

from triage.llm import toxicity as T
from triage.llm.queries import op4_toxicity

SF = "/root/testdata/sf0.1"


def brute_segments(scores):
    """Take the best segment, then those left and right of it, as the definition says."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    a, b = at
    right = [(x + b, y + b) for x, y in brute_segments(scores[b:])]
    return brute_segments(scores[:a]) + [at] + right


def test_segments_equal_the_recursive_definition():
    rng = random.Random(5)
    for _ in range(300):
        # Distinct sums, so that no two segments tie.
        s = [rng.choice([-1, -1, -1, 2, 5]) * (1 + rng.random()) for _ in range(rng.randint(0, 18))]
        got = [(a, b) for a, b, _ in T.segments(np.array(s, dtype=float))]
        assert got == brute_segments(s), s


def test_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op4_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.8
    assert n.get((0, 1), 0) / n[0, 0] <= 0.02


def labels_of(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int") if pairs else spark.createDataFrame([], "doc_id long, quality int, toxic int")


def made(docs, spark):
    rng = random.Random(2)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=60)
        if i % 8 == 0:
            words[rng.randrange(60)] = "vilefoo"
            words[rng.randrange(60)] = "nastybar"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 8 == 0)))
    return docs(rows), labels_of(spark, labels)


def test_passages_and_odd_rows(spark, docs, odd_rows):
    table, labels = made(docs, spark)
    model = T.fit(table, labels)
    assert model.fitted and {"vilefoo", "nastybar"} <= set(model.scores)
    rows = T.passages(docs([*odd_rows, (90, "so you vilefoo nastybar vilefoo are"), (91, "VILEFOO, nastybar vilefoo!")], extra=True), model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[90]["score"] > 0.5 and [(p["start"], p["end"]) for p in by[90]["passages"]] == [(2, 5)]
    assert by[91]["score"] > 0.5
    assert by[3]["score"] == by[4]["score"] == by[6]["score"] < 0.5
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == len(odd_rows) + 2


def test_without_labels(spark, docs, odd_rows):
    model = T.fit(docs(odd_rows), labels_of(spark, []))
    assert not model.fitted
    assert {r["score"] for r in T.passages(docs(odd_rows), model).collect()} == {0.0}
    assert T.passages(docs([]), model).count() == 0


def test_held_out_labels_do_not_matter(spark, docs):
    table, labels = made(docs, spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.fit(table, labels) == T.fit(table, flipped)


def plain_fit(rows, labels):
    """Token scores, rate, density and curve from (doc_id, text) rows, worked out in one loop each."""
    import zlib
    from collections import Counter

    folds = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    groups = {}
    for i, text in rows:
        if folds[i]:
            groups.setdefault((T.smallest_hash(T.tokens_of(text)), labels[i]), []).append((i, text))
    assert all(len({t for _, t in g}) == 1 for g in groups.values())  # else the smallest hashed id decides
    assert all(len(g) == 1 for g in groups.values())
    sample = [(g[0][1], y, folds[g[0][0]]) for (_, y), g in groups.items()]
    seen = {0: Counter(), 1: Counter()}
    for text, y, fold in sample:
        if fold != 4:
            own = set(T.tokens_of(text))
            seen[y].update(own | {w[: T.STEM] + "*" for w in own if len(w) >= T.STEM})
    scores = {}
    for stems in (False, True):
        own = [t for t in seen[0] | seen[1] if t.endswith("*") == stems]
        c, t, size = sum(seen[0][x] for x in own), sum(seen[1][x] for x in own), 0.5 * len(own)
        for x in own:
            a, b = seen[1][x] + 0.5, seen[0][x] + 0.5
            s = np.log(a / (t + size - a)) - np.log(b / (c + size - b)) - T.CAUTION * np.sqrt(1 / a + 1 / b)
            if s >= T.LEAST:
                scores[x] = s
    model, held = T.ToxicityModel(scores), [(text, y) for text, y, fold in sample if fold == 4]
    clean = [model.token_scores(T.tokens_of(text)) for text, y in held if y == 0]
    every, floor = np.concatenate([*clean, [min(scores.values())]]), min(scores.values())
    low, high = 0.0, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if np.exp(every * mid).mean() < 1 else (low, mid)
    model.rate = max(low, 0.05)
    above = 1 + sum(s >= floor for x in clean for *_, s in T.segments(x))
    model.density = above / (len(every) * np.exp(-model.rate * floor))
    xs = np.array([[1.0, model.evidence(T.tokens_of(text))] for text, _ in held])
    ys, w = np.array([y for _, y in held], dtype=float), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-xs @ w))
        w -= np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs + 1e-3 * np.eye(2), xs.T @ (p - ys) + 1e-3 * w)
    model.offset, model.slope, model.fitted = *w, True
    return model


def test_fit_and_scores_equal_a_plain_version_for_any_order(spark, docs):
    table, labels = made(docs, spark)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    want = plain_fit(rows, {r["doc_id"]: r["toxic"] for r in labels.collect()})
    for parts in (1, 50):
        model = T.fit(table.orderBy(F.rand(parts)).repartition(parts), labels)
        assert model.scores.keys() == want.scores.keys()
        assert all(abs(model.scores[k] - v) < 1e-12 for k, v in want.scores.items())
        for name in ("rate", "density", "offset", "slope"):
            assert abs(getattr(model, name) - getattr(want, name)) < 1e-6 * max(1, abs(getattr(want, name))), name
        for r in T.passages(table, model).collect()[:100]:
            own = T.tokens_of(dict(rows)[r["doc_id"]])
            assert abs(r["score"] - want.score(want.evidence(own))) < 1e-6


def test_one_row_stands_for_copies_whatever_their_order(spark, docs):
    table, labels = made(docs, spark)
    again = table.unionByName(table.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1000))
    more = labels.unionByName(labels.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1000))
    fits = [T.fit(again.orderBy(F.rand(n)).repartition(n), more) for n in (1, 3, 20)]
    assert fits[0] == fits[1] == fits[2] and fits[0].fitted
