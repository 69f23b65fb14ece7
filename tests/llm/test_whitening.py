import math

import numpy as np
import pytest

from triage.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "x") for i, v in rows], SCHEMA)


def brute(rows):
    """By row id in order: (n, deviation, whitened matrix, explained), the plain way."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, k = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(k)]
    y = np.array([[float(n * r[i] - s[i]) / n for i in range(k)] for r in x])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:32], v[:, ::-1][:, :32]
    deviation = [sum((n * r[i] - s[i]) ** 2 for i in range(k)) for r in x]
    return deviation, y @ v / np.sqrt(e), e / np.trace(y.T @ y / n)


def random_rows(n=400, k=40, seed=1):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, k)) @ rng.normal(size=(k, k)) * np.linspace(3, 0.2, k)
    return [(i * 3, [float(c) for c in r]) for i, r in enumerate(mixed)]


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, parts):
    rows = random_rows()
    out, tables = W.whiten(frame(spark, rows).repartition(parts))
    got = {}
    for r in out.collect():
        got[r["vec_id"], r["component"]] = r
        assert r["n"] == 400 and r["identity_error"] <= 1e-9
    assert len(got) == 400 * 32
    deviation, white, explained = brute(rows)
    for c in range(32):
        mine = np.array([got[i, c + 1]["whitened"] for i, _ in rows])
        sign = np.sign(mine @ white[:, c])
        assert np.allclose(mine, sign * white[:, c], rtol=1e-6, atol=1e-7)
        assert math.isclose(got[0, c + 1]["explained"], explained[c], rel_tol=1e-9)
    assert [got[i, 1]["deviation"] for i, _ in rows] == deviation
    for t in tables:
        t.drop()


def test_covariance_of_pair_sums_is_exact():
    rng = np.random.default_rng(2)
    d = rng.integers(-500, 500, size=(300, 9))
    a = W.squares(d)
    for i in range(9):
        assert a[i, i] == (d[:, i] ** 2).sum()
        for j in range(i + 1, 9):
            assert (a[i, j] - a[i, i] - a[j, j]) == 2 * (d[:, i] * d[:, j]).sum()
    wide = W.squares(d * (1 << 40))
    assert all(int(wide[i, j]) == int(a[i, j]) << 80 for i in range(9) for j in range(i, 9))


def test_odd_rows(spark):
    rows = random_rows(60, 4)
    odd = [
        (1000, None),
        (1001, []),
        (1002, [1.0, None, 2.0, 3.0]),
        (1003, [float("nan"), 1.0, 1.0, 1.0]),
        (1004, [float("inf"), 1.0, 1.0, 1.0]),
        (None, rows[0][1]),
        (0, rows[0][1]),
        (0, rows[0][1]),
        (2000, [1.0, 2.0]),  # a length of its own, one row
        (3000, [1e30, -1e30, 1.0]),
        (3001, [2e30, 1.0, 0.5]),
    ]
    out, _ = W.whiten(frame(spark, rows + odd))
    got = out.collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in rows} | {None, 2000, 3000, 3001}
    main = [r for r in got if r["vec_id"] not in (2000, 3000, 3001)]
    assert {r["n"] for r in main} == {63} and len(main) == 63 * 4
    assert all(r["identity_error"] < 1e-9 for r in main)
    alone = [r for r in got if r["vec_id"] == 2000]
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in alone] == [
        (c, 1, 0, 0.0, 0.0) for c in (1, 2)
    ]
    assert all(math.isfinite(r["whitened"]) for r in got)


def test_empty_table(spark):
    out, _ = W.whiten(frame(spark, [(1, None)]))
    assert out.collect() == [] and out.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]
