import json

import pytest

from triage import fixed_values as fv
from triage.operators import evaluate as ev
from triage.plans.jobs import evaluate
from triage.sources import tickets as src

# Published confusion matrices (rows true, columns predicted) and figures.
MATRICES = {
    "val": [
        [395, 59, 26, 27, 9],
        [7, 762, 19, 13, 11],
        [4, 14, 1433, 34, 22],
        [13, 6, 30, 443, 31],
        [8, 16, 42, 38, 168],
    ],
    "test": [
        [389, 60, 22, 36, 9],
        [7, 766, 23, 6, 10],
        [2, 21, 1450, 23, 11],
        [12, 4, 18, 452, 37],
        [15, 10, 43, 34, 170],
    ],
}
FIGURES = {
    "val": (0.8818181818181818, 0.8330514167866614, 0.8800495316361098),
    "test": (0.8889807162534435, 0.8397948257431539, 0.8867473096375319),
}
F1 = {
    "val": (0.8377518557794273, 0.9131216297183943, 0.9375204448806019, 0.8218923933209648,
            0.6549707602339181),
    "test": (0.8267800212539851, 0.9157202630005977, 0.9467841984982044, 0.8417132216014898,
             0.6679764243614931),
}
SCHEMA = "ticket_id long, split string, y_true string, y_pred string, conf double"


@pytest.fixture(scope="module")
def golden(spark):
    cells = [
        (s, fv.CATEGORIES[i], fv.CATEGORIES[j], n)
        for s, m in MATRICES.items()
        for i, r in enumerate(m)
        for j, n in enumerate(r)
    ]
    return spark.createDataFrame(cells, "split string, y_true string, y_pred string, n long")


def test_published_figures(golden):
    for r in ev.metrics_overall(golden).collect():
        assert (r["accuracy"], r["macro_f1"], r["weighted_f1"]) == pytest.approx(
            FIGURES[r["split"]], abs=1e-12
        )
        assert r["n"] == 3630
    per_class = {(r["split"], r["label"]): r for r in ev.metrics_per_class(golden).collect()}
    for s, values in F1.items():
        for c, f1 in zip(fv.CATEGORIES, values):
            assert per_class[s, c]["f1"] == pytest.approx(f1, abs=1e-12)
    assert per_class["val", "Billing"]["support"] == 516


def test_published_gate(golden):
    got = {(r["split"], r["metric"]): r["passed"] for r in ev.quality_gate(golden).collect()}
    assert got == {(s, m): True for s in MATRICES for m in ("accuracy", "macro_f1")}


def test_confusion_matrix_and_report(golden):
    rows = {(r["split"], r["y_true"]): r for r in ev.confusion_matrix(golden).collect()}
    for s, m in MATRICES.items():
        for c, line in zip(fv.CATEGORIES, m):
            assert [rows[s, c][x] for x in fv.CATEGORIES] == line
    report = {(r["split"], r["label"]): r for r in ev.classification_report(golden).collect()}
    assert len(report) == 2 * (len(fv.CATEGORIES) + 3)
    assert report["test", "accuracy"]["f1"] == pytest.approx(FIGURES["test"][0])
    assert report["test", "weighted avg"]["f1"] == pytest.approx(FIGURES["test"][2])
    assert report["test", "macro avg"]["recall"] == pytest.approx(0.829729, abs=1e-5)
    compare = {r["label"]: r for r in ev.metrics_compare(golden).collect()}
    assert compare["Billing"]["test_P"] == 0.915 and compare["Billing"]["val_F1"] == 0.838


PREDICTIONS = [
    (1, "val", "Billing", "Billing", 1.0),
    (2, "val", "Billing", "Bug Report", 0.0),
    (3, "val", "Bug Report", "Billing", 0.30),
    (4, "val", "Bug Report", "Bug Report", 0.55),
    (5, "val", "Technical Setup", "Bug Report", 0.55),
    (6, "test", "Authentication", "Authentication", 0.9499),
    (7, "test", "Authentication", "Billing", 0.95),
    (8, "test", "Authentication", "Billing", 0.95),
]


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame(PREDICTIONS, SCHEMA)


def test_never_predicted_and_never_seen_classes(predictions):
    got = {(r["split"], r["label"]): r
           for r in ev.metrics_per_class(ev.confusion_counts(predictions)).collect()}
    assert len(got) == 10
    assert got["val", "Technical Setup"]["precision"] == 0.0
    assert got["val", "Feature Request"]["f1"] == 0.0
    assert got["test", "Billing"]["recall"] == 0.0


def test_threshold_sweep_equals_filtering(predictions):
    got = {(r["split"], r["threshold"]): (r["coverage"], r["acc_at_or_above"], r["n"])
           for r in ev.threshold_sweep(predictions).collect()}
    want = {}
    for s in ("val", "test"):
        mine = [p for p in PREDICTIONS if p[1] == s]
        for t in fv.SWEEP_THRESHOLDS:
            covered = [p for p in mine if p[4] >= t]
            if covered:
                right = sum(p[2] == p[3] for p in covered)
                want[s, t] = (
                    round(len(covered) / len(mine), 4), round(right / len(covered), 4),
                    len(covered),
                )
    assert got == want


def test_histogram_covers_all(predictions):
    got = {(r["split"], r["correct"], r["bin"]): r["n"]
           for r in ev.confidence_histogram(predictions).collect()}
    assert got["val", True, 19] == 1 and got["val", False, 0] == 1
    assert sum(got.values()) == len(PREDICTIONS)


def test_error_lists(predictions):
    assert [tuple(r) for r in ev.confused_pairs(predictions, 2).collect()] == [
        ("Authentication", "Billing", 2),
        ("Billing", "Bug Report", 1),
    ]
    assert [r["ticket_id"] for r in ev.confident_errors(predictions, 3).collect()] == [7, 8, 5]


def test_all_tables_and_the_document(predictions, golden, tmp_path):
    tables = evaluate(predictions)
    assert all(t.count() > 0 for t in tables.values())
    src.write_document(ev.metrics_document(golden), str(tmp_path / "doc"))
    lines = [json.loads(x) for f in (tmp_path / "doc").glob("*.json") for x in f.open()]
    assert {x["split"] for x in lines} == {"val", "test"}
    assert len(lines[0]["per_class"]) == 5 and len(lines[0]["confusion_matrix"]) == 5
    src.write_metrics(ev.metrics_overall(golden), str(tmp_path / "overall"))
