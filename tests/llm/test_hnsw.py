import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from triage.llm import hnsw as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ok = []
    for i, v, label in rows:
        if label is None or i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float32).astype(float)
        ok.append((i, x / np.linalg.norm(x), label))
    links = {i: 0 for i, *_ in rows}
    parent = {i: i for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= threshold:
                links[ok[a][0]] += 1
                links[ok[b][0]] += 1
                x, y = root(ok[a][0]), root(ok[b][0])
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {i: (links[i], root(i)) for i in links}


def clustered(n=600, dims=32, labels=3, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dims))
    rows = []
    for i in range(n):
        c = i % 60 if i % 3 else 0  # one group holds a third
        spread = 0.02 if c else 0.1
        v = centres[c] / np.linalg.norm(centres[c]) + spread * rng.normal(size=dims) / np.sqrt(dims) * (1 if i % 2 else 3)
        rows.append((i, [float(x) for x in v], c % labels))
    return rows


@pytest.mark.parametrize("shard_size", [8192, 70])
def test_links_equal_brute_force(spark, shard_size):
    rows = clustered()
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(4)]  # copies
    wanted = brute(rows)
    out, _ = H.near_vectors(spark.createDataFrame(rows, SCHEMA), shard_size=shard_size)
    got = {r["vec_id"]: r for r in out.collect()}
    assert len(got) == len(rows) and max(n for n, _ in wanted.values()) > 40
    found = sum(min(got[i]["n_links"], n) for i, (n, _) in wanted.items())
    total = sum(n for n, _ in wanted.values())
    assert all(got[i]["n_links"] <= n for i, (n, _) in wanted.items())
    assert found / total >= 0.995
    same = np.mean([got[i]["component_id"] == c for i, (_, c) in wanted.items()])
    assert same >= 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    near = H.near_vectors(df, threshold=0.4)[0].collect()  # a threshold at which many link
    wanted = brute(rows, 0.4)
    total = sum(n for n, _ in wanted.values())
    assert total > 100
    assert sum(r["n_links"] for r in near) / total >= 0.97


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1),
        (6, [nan, 0.0], 1), (7, [inf, 0.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1),
        (11, [], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (None, [1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as node", "3 as group")
    out = H.near_vectors(df)[0].collect()
    assert len(out) == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[12] == (3, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert got[i] == (0, i, True), i
    assert got[None] == (0, None, False)


def test_empty_table(spark):
    assert H.near_vectors(spark.createDataFrame([], SCHEMA))[0].count() == 0


def found_pairs(graph, raw, queries, **how):
    args = {"threshold": 0.98, "beam": 32, "audit": 64, **how}
    return {p for at, rows in H.links_above(graph, raw, queries, **args) for p in zip(at.tolist(), rows.tolist(), strict=True)}


def wanted_pairs(raw, queries, threshold=0.98):
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (queries, raw))
    return set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= threshold)), strict=True))


def test_beam_widens_until_a_group_is_whole():
    rng = np.random.default_rng(0)
    v = np.concatenate([np.ones((300, 16)) + 0.01 * rng.normal(size=(300, 16)), rng.normal(size=(200, 16))])
    found = found_pairs(H.Graph(H._unit(v)), v, v[:5], beam=8, audit=2)
    assert found == wanted_pairs(v, v[:5]) and len(found) >= 1500


def test_tight_groups_among_many_single_vectors():
    """Every vector finds itself and its group, whatever the seed."""
    for seed in range(12):
        rng = np.random.default_rng(seed)
        groups = [rng.normal(size=64) + 0.02 * rng.normal(size=(150, 64)) for _ in range(6)]
        v = np.concatenate([*groups, rng.normal(size=(300, 64))]).astype(np.float32).astype(float)
        v = v[rng.permutation(len(v))]
        assert found_pairs(H.Graph(H._unit(v)), v, v) == wanted_pairs(v, v), seed


def test_links_between_shards_are_found():
    """Shards between which only one query in a hundred has a link."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        v = rng.normal(size=(3000, 48))
        q = rng.normal(size=(3000, 48))
        linked = rng.choice(3000, 30, replace=False)
        q[linked] = v[linked] + 0.12 * rng.normal(size=(30, 48))
        found = found_pairs(H.Graph(H._unit(v)), v, q)
        assert found == wanted_pairs(v, q) and 20 <= len(found) <= 30


def test_pairs_at_the_threshold_are_decided_in_double_precision():
    v = np.array([[1.0, 0.0], [0.98, math.sqrt(1 - 0.98**2)], [0.98 - 1e-9, math.sqrt(1 - (0.98 - 1e-9) ** 2)]])
    found = found_pairs(H.Graph(H._unit(v)), v, v)
    assert (0, 2) not in found and (0, 0) in found


@pytest.mark.parametrize("parts", [1, 13])
def test_result_does_not_hang_on_the_order_of_rows(spark, parts):
    rows = clustered(400)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, H.near_vectors(df.repartition(2), shard_size=60)[0].collect()))
    got = sorted(map(tuple, H.near_vectors(df.orderBy(F.rand(parts)).repartition(parts), shard_size=60)[0].collect()))
    assert got == want and min(r[1] for r in got) >= 0
