import numpy as np
import pytest
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage.operators import features as ft
from triage.operators import model as mo
from triage.operators import solver

CORPUS = {
    "Billing": [
        "My card was charged two times for the same invoice.",
        "Please refund the payment of last month, the invoice is wrong.",
        "The receipt of my subscription shows an extra charge.",
        "I paid the invoice but the payment is still open.",
        "Why is my subscription charged again after the refund?",
    ],
    "Authentication": [
        "The password reset link never arrives, I cannot log in.",
        "My login fails although the password is right.",
        "The two factor code for my login is rejected.",
        "Account locked after three login attempts with my password.",
        "Log in with the new password does not let me into the account.",
    ],
    "Bug Report": [
        "The app crashes when I open the report page.",
        "After the update the page is blank and the app freezes.",
        "An error appears and the app crashes while saving.",
        "Upload is broken, the server answers with an error.",
        "The app freezes with an error when I open the calendar.",
    ],
    "Feature Request": [
        "Please add a dark theme to the dashboard.",
        "It would be nice to have a calendar export, please add it.",
        "Could you add a shortcut for the dashboard?",
        "I wish there was a way to add notes, a feature many want.",
        "Could you please add an option for weekly digests, a small feature?",
    ],
    "Technical Setup": [
        "How do I install the client on a new machine?",
        "Where do I configure the docker container for the server?",
        "Which steps install the sdk and configure the key?",
        "How do I configure the proxy to install packages?",
        "Guide to install the docker image and configure ports.",
    ],
}
CANONICAL = [
    ("I was charged again, please refund my payment.", "Billing"),
    ("My LOGIN password is REJECTED.", "Authentication"),
    ("The app <b>crashes</b> with an error, see https://x.example/log", "Bug Report"),
    ("Could you please add a dark dashboard?", "Feature Request"),
    ("How do I install and configure docker?", "Technical Setup"),
]


def table(spark, pairs):
    rows = [(i, t, c) for i, (t, c) in enumerate(pairs)]
    return spark.createDataFrame(rows, "ticket_id long, text string, category string")


@pytest.fixture(scope="module")
def train(spark):
    return table(spark, [(t, c) for c, ts in CORPUS.items() for t in ts])


@pytest.fixture(scope="module")
def model(train):
    return mo.fit_topics(train)


def dense(rows, n_terms):
    x = np.zeros((len(rows), n_terms + 1))
    for i, r in enumerate(rows):
        x[i, r["indices"]] = r["values"]
    x[:, -1] = 1.0
    return x


def newton(x, sign, cost):
    """The same problem by full Newton steps on a dense matrix."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        z = sign * (x @ w)
        p = 1 / (1 + np.exp(z))
        g = w - x.T @ (sign * cost * p)
        h = np.eye(len(w)) + (x.T * (cost * p * (1 - p))) @ x
        w -= np.linalg.solve(h, g)
    return w


def test_coefficients_equal_a_dense_newton_solver(train):
    vocab = ft.fit_tfidf(train)
    rows = ft.sparse_rows(train, vocab).collect()
    x = dense(rows, vocab.n_terms)
    fitted = mo.fit_topics(train, tol=1e-9)
    coef = {r["idx"]: r["coef"] for r in fitted.terms.collect()}
    for k, c in enumerate(fitted.classes):
        mine = np.array([r["category"] == c for r in rows])
        w = newton(x, np.where(mine, 1.0, -1.0), np.where(mine, len(rows) / (5 * mine.sum()), 1.0))
        got = np.array([coef[i][k] for i in range(vocab.n_terms)])
        assert np.abs(got - w[:-1]).max() < 1e-6
        assert abs(fitted.intercepts[k] - w[-1]) < 1e-6


def test_merge_gives_the_driver_each_range_once(spark, train, model, monkeypatch):
    monkeypatch.setattr(solver, "RANGE", 16)
    again = mo.fit_topics(train.repartition(40))
    assert again.intercepts == pytest.approx(model.intercepts, abs=1e-6)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 100)) * (rng.random((60, 100)) < 0.1)
    shared = spark.sparkContext.broadcast(vectors)

    def task(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield solver._ranges(shared.value[i])

    partial = spark.range(60).repartition(60).mapInArrow(task, solver.SUMS)
    assert partial.count() > 300
    assert np.allclose(solver._merge(partial, 100), vectors.sum(axis=0))


def test_fit_rows_are_bounded(train):
    rows, sizes = mo._fit_rows(train, "category", "ticket_id", 10_000)
    assert rows is train and sum(sizes.values()) == train.count()
    rows, sizes = mo._fit_rows(train, "category", "ticket_id", train.count() // 2)
    assert 0 < rows.count() == sum(sizes.values()) < train.count()


def test_rare_classes_are_fitted_on_whole(spark):
    rows = spark.range(50_100).selectExpr("id as ticket_id", "if(id % 501 = 0, 'rare', 'common') as category")
    chosen, sizes = mo._fit_rows(rows, "category", "ticket_id", 1000)
    assert sizes["rare"] == 100 and 800 < sizes["common"] < 1200
    assert chosen.count() == sum(sizes.values())


def test_rows_count_for_those_they_stand_for():
    labels = np.array([0, 1, 1])
    index, value, w = np.array([0, 1, 0]), np.array([1.0, 0.5, 2.0]), np.array([[0.3], [-0.2], [0.1]])

    def sums(rows, stands_for):
        out = np.zeros(1), np.zeros((1, 3)), np.zeros((1, 3))
        lengths = np.arange(len(rows) + 1)
        p = [solver.Problem(1, 2, 3, 1.5, 1.0, stands_for)]
        solver._batch_sums(labels[rows], lengths, index[rows], value[rows], w, p, *out)
        return np.concatenate([x.ravel() for x in out])

    assert np.allclose(sums([0, 1, 2], (3.0, 2.0)), sums([0, 0, 0, 1, 1, 2, 2], ()))


def test_canonical_tickets(spark, model):
    asked = table(spark, CANONICAL)
    got = {r["ticket_id"]: r["category"] for r in mo.predict(asked, model).collect()}
    assert got == {i: c for i, (_, c) in enumerate(CANONICAL)}


def test_probabilities(spark, model):
    asked = table(spark, CANONICAL)
    assert model.classes == tuple(sorted(fv.CATEGORIES))
    proba = {r[0]: r["proba"] for r in mo.predict_proba(asked, model).collect()}
    for r in mo.predict_with_confidence(asked, model).collect():
        p = proba[r["ticket_id"]]
        assert sum(p) == pytest.approx(1) and all(0 <= v <= 1 for v in p)
        assert r["category"] == model.classes[int(np.argmax(p))]
        assert r["confidence"] == max(r["scores"].values())
        assert set(r["scores"]) == set(fv.CATEGORIES)


def test_decision_function_is_the_dot_product(train, model):
    vocab = ft.TfidfModel(model.terms, model.n_terms, model.n_bytes, model.n_docs)
    rows = ft.sparse_rows(train, vocab).collect()
    coef = np.zeros((model.n_terms, 5))
    for r in model.terms.collect():
        coef[r["idx"]] = r["coef"]
    want = dense(rows, model.n_terms)[:, :-1] @ coef + np.array(model.intercepts)
    got = {r["ticket_id"]: r["scores"] for r in mo.decision_function(train, model).collect()}
    for r, w in zip(rows, want):
        assert got[r["ticket_id"]] == pytest.approx(list(w))


def test_empty_null_and_unknown_texts_get_a_class(spark, model):
    asked = spark.createDataFrame(
        [(1, ""), (2, None), (3, "zzz qqq"), (4, "123")], "ticket_id long, text string"
    )
    got = mo.predict_with_confidence(asked, model).collect()
    assert {r["ticket_id"] for r in got} == {1, 2, 3, 4}
    assert all(r["category"] in fv.CATEGORIES for r in got)


def test_copies_with_one_id_score_like_one(spark, model):
    one = spark.createDataFrame([("a", CANONICAL[0][0]), ("b", "")], "ticket_id string, text string")
    many = one.union(one).union(one)
    want = {r[0]: r[1] for r in mo.decision_function(one, model).collect()}
    got = {r[0]: r[1] for r in mo.decision_function(many, model).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_save_and_load(spark, train, model, tmp_path):
    path = str(tmp_path / "deep" / "model")
    model.save(path)
    again = mo.TopicModel.load(spark, path)
    assert again.classes == model.classes and again.intercepts == model.intercepts
    a = mo.predict_proba(train, model).orderBy("ticket_id").collect()
    b = mo.predict_proba(train, again).orderBy("ticket_id").collect()
    for x, y in zip(a, b):
        assert x["proba"] == pytest.approx(y["proba"], abs=1e-12)


def test_large_vocabulary_scores_alike(train, model, monkeypatch):
    whole = {r[0]: r[1] for r in mo.decision_function(train, model).collect()}
    monkeypatch.setattr(ft, "BROADCAST_BYTES", 9000)
    assert model.n_bytes > 2 * 9000
    scored = mo.decision_function(train, model)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    parts = {r[0]: r[1] for r in mo.decision_function(train, model).collect()}
    assert parts.keys() == whole.keys()
    assert all(parts[k] == pytest.approx(whole[k]) for k in whole)


def test_two_classes_and_own_weights(spark, train):
    two = train.where(F.col("category").isin("Billing", "Bug Report"))
    fitted = mo.fit_topics(two, class_weight={"Billing": 2.0}, C=0.5)
    assert fitted.classes == ("Billing", "Bug Report")
    assert fitted.intercepts[0] == -fitted.intercepts[1]
    right = mo.predict(two, fitted).join(two.withColumnRenamed("category", "c"), "ticket_id")
    assert right.where("category <> c").count() == 0


def test_features_and_names(model):
    names = mo.feature_names(model)
    assert names.count() == model.n_terms > 100
    assert names.where(F.col("term").startswith(" ")).count() > 0
    top = mo.top_features(model, 3).collect()
    assert len(top) == 15
    best = {r["category"]: r["coef"] for r in top if r["rank"] == 1}
    assert set(best) == set(fv.CATEGORIES) and min(best.values()) > 0


def test_one_class_is_refused(train):
    with pytest.raises(ValueError):
        mo.fit_topics(train.where("category = 'Billing'"))


def test_rows_without_terms_and_small_slices(monkeypatch):
    labels = np.array([0, 1, 0, 1])
    offsets, index = np.array([0, 2, 2, 3, 3]), np.array([0, 2, 1])
    value, w = np.array([1.0, 2.0, 3.0]), np.array([[0.1], [0.2], [0.3], [0.4]])
    p = [solver.Problem(1, 2, 4, 2.0, 1.0)]

    def sums(size):
        monkeypatch.setattr(solver, "SLICE", size)
        losses, grads, squares = np.zeros(1), np.zeros((1, 4)), np.zeros((1, 4))
        solver._batch_sums(labels, offsets, index, value, w, p, losses, grads, squares)
        return losses, grads, squares

    margins = np.array([0.1 + 0.6 + 0.4, 0.4, 0.6 + 0.4, 0.4])
    sign, cost = np.array([-1, 1, -1, 1.0]), np.array([1, 2, 1, 2.0])
    want = (cost * np.log1p(np.exp(-sign * margins))).sum()
    pull = -sign * cost / (1 + np.exp(sign * margins))
    for size in (1, 2, 100):
        losses, grads, squares = sums(size)
        assert losses[0] == pytest.approx(want)
        assert grads[0] == pytest.approx([pull[0], 3 * pull[2], 2 * pull[0], pull.sum()])
        assert squares[0] == pytest.approx([0.25, 2.25, 1.0, 1.5])


def test_a_classifier_that_names_one_class_is_seen(spark, monkeypatch):
    from queries.topics import agreeing, scored_plainly

    rows = table(spark, [(t, c) for c, texts in CORPUS.items() for t in texts] + [("", None), ("qqq", None)])
    model = mo.fit_topics(rows, min_df=1)
    plain = scored_plainly(model, rows).persist()

    def agreed():
        found = mo.predict_with_confidence(rows, model)
        return [r["agrees"] for r in agreeing(found, plain, "confidence").collect()]

    assert all(agreed()) and plain.select("plain_category").distinct().count() > 2
    best = mo.best_class
    monkeypatch.setattr(mo, "best_class", lambda p, m: (F.lit("Billing"), best(p, m)[1]))
    assert not all(agreed())
    monkeypatch.setattr(mo, "best_class", lambda p, m: (best(p, m)[0], F.lit(0.9)))
    assert not any(agreed())
