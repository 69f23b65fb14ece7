"""Terms exchanged many to a row, and fits on every row."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from test_features import expected
from test_model import CORPUS, table
from test_text import char_grams
from triage.functions import grams as gr
from triage.functions import text as tx
from triage.operators import features as ft
from triage.operators import model as mo
from triage.operators import solver

SPANS = {"word": (1, 2), "char": (3, 5)}
ODD = ["naïve ﬁsh x yy", "", "a-b c_d e1 ∑∑ 한국", "Straße ½ kg", None, "zz  zz", "é", "日本 語"]


def test_words_of_one_string_are_the_tokens(apply):
    tokens = apply(lambda c: tx.word_tokens(tx.clean_text_or_empty(c)), ODD)
    strings = apply(lambda c: tx.word_string(tx.clean_text_or_empty(c)), ODD)
    assert gr.words_of(pa.array(strings)).to_pylist() == tokens
    assert gr.words_of(pa.array(strings).slice(2, 3)).to_pylist() == tokens[2:5]


def test_hashes_depend_on_the_term_alone():
    terms = ["a", "ab", "ba", "naïve", "", "x" * 3000, "ab"]
    whole = gr.hashes(pa.array(terms))
    assert len(set(whole.tolist())) == len(terms) - 1
    assert [gr.hashes(pa.array([t]))[0] for t in terms] == whole.tolist()
    assert gr.hashes(pa.array(terms).slice(2, 3)).tolist() == whole[2:5].tolist()


def test_packed_columns_come_back():
    columns = np.array([3, 1, 9], np.int64), np.array([0.5, -1.0, 7.0]), np.arange(6.0)
    raw, packed = gr.pack(*columns, rising=(0,))
    got = gr.unpack(3, raw, packed, [(np.int64, 1), (np.float64, 1), (np.float64, 2)], rising=(0,))
    assert got[0].tolist() == [3, 1, 9] and got[1].tolist() == columns[1].tolist()
    assert got[2].tolist() == [[0, 1], [2, 3], [4, 5]] and len(got[3]) == 0


def test_a_task_holds_the_terms_of_few_texts(monkeypatch):
    """A batch of long texts is counted some at a time."""
    monkeypatch.setattr(gr, "BATCH_CHARS", 20)
    texts = [f"some words no {i}" for i in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(texts)], ["_word", "_char"])
    parts = list(gr.counting(("word", "char"), SPANS, 3)([batch]))
    assert len(parts) == 24
    assert max(sum(p.column("_n").to_pylist()) for p in parts) < 60


@pytest.mark.parametrize("chars", [10, 4_000_000])
def test_terms_are_counted_once_each(texts, monkeypatch, chars):
    """One row for a term, whatever tasks and parts its tickets were counted in."""
    monkeypatch.setattr(ft, "PART_CHARS", chars)
    monkeypatch.setattr(gr, "BATCH_CHARS", chars)
    rows = ["red fox", "red fox red", "", None, "blue fox"] * 3
    counted = ft.count_terms(texts(rows).repartition(4), combined=True).collect()
    assert len({(r["block"], r["term"]) for r in counted}) == len(counted)
    df, tf = Counter(), Counter()
    for t in rows:
        found = char_grams(t or "")
        tf.update(found)
        df.update(set(found))
    got = {r["term"]: (r["df"], r["tf"]) for r in counted if r["block"] == "char"}
    assert got == {t: (df[t], tf[t]) for t in df}
    words = {r["term"]: (r["df"], r["tf"]) for r in counted if r["block"] == "word"}
    assert words["red"] == (6, 9) and words["red fox"] == (6, 6) and words["fox red"] == (3, 3)


def test_parts_of_the_term_table_change_nothing(texts, monkeypatch):
    """Shards, parts and shelves of any number give the weights said in Python."""
    rows = ["Refund the invoice", "the login page", "login the login page", "", None] * 3
    monkeypatch.setattr(ft, "BROADCAST_BYTES", 700)
    monkeypatch.setattr(ft, "PART_ROWS", 10)
    monkeypatch.setattr(gr, "SHELF_ROWS", 7)
    corpus = texts(rows)
    found = ft.tfidf(corpus, ft.fit_tfidf(corpus)).collect()
    want = expected(rows)[0]
    got = {(r["ticket_id"], r["block"], r["term"]): r["weight"] for r in found}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_every_row_is_fitted_on(spark, monkeypatch):
    """However many rows there are: a table above the former bound of rows is not thinned out."""
    seen = []
    fit = mo.fit_logistic
    monkeypatch.setattr(mo, "fit_logistic", lambda rows, *a, **b: seen.append(rows.count()) or fit(rows, *a, **b))
    monkeypatch.setattr(mo, "MAX_FIT_ROWS", 10, raising=False)
    pairs = [(t, c) for c, ts in CORPUS.items() for t in ts]
    model = mo.fit_topics(table(spark, pairs), max_iter=2)
    assert seen == [len(pairs)] and model.n_docs == len(pairs)
    assert mo.fit_topics.__kwdefaults__["max_fit_rows"] is None


@pytest.mark.parametrize("entries,piece", [(4_000_000, 4_000_000), (40, 30)])
def test_blocks_are_the_matrix(spark, monkeypatch, entries, piece):
    monkeypatch.setattr(solver, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(solver, "PIECE_ENTRIES", piece)
    rng = np.random.default_rng(3)
    x = rng.random((30, 25)) * (rng.random((30, 25)) < 0.3)
    x[4] = 0.0
    x[:, 7] = 0.0
    coef = rng.normal(size=(25, 2))
    rows = [(i, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for i, r in enumerate(x)]
    features = spark.createDataFrame(rows, "no int, indices array<int>, values array<double>").repartition(3)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(coef)], "idx long, coef array<double>")
    blocks = solver.Blocks(features, ["no"], int((x > 0).sum()), table, exact=True)
    no = blocks.own_column(np.int32)
    assert sorted(no) == list(range(30))
    x = x[no]
    assert np.allclose(blocks.scores(2), (x @ coef).T)
    numbers = rng.normal(size=(2, 30))
    assert np.allclose(blocks.margins(numbers), numbers @ x @ x.T + numbers.sum(axis=1)[:, None])
    got = {r["idx"]: r["coef"] for r in blocks.coefficients(numbers).collect()}
    assert set(got) == set(np.flatnonzero(x.any(axis=0)))
    assert all(got[i] == pytest.approx((numbers @ x)[:, i].tolist()) for i in got)
    there = x.any(axis=0)
    want = [((2 * numbers[0] @ x + coef[:, 1])[there] ** 2).sum(), ((3 * numbers[1] @ x) ** 2).sum()]
    assert blocks.squares(numbers, [(1, 2.0), (-1, 3.0)]) == pytest.approx(want)
    by_row = {r["no"]: r["v"] for r in blocks.rows(numbers, "v", features.schema).collect()}
    assert all(by_row[i] == numbers[:, at].tolist() for at, i in enumerate(no))
    blocks.close()


def test_sums_of_entries_are_those_of_the_rows(spark):
    """Also where rows share an id: their entries are added up as ``sparse_rows`` gives them."""
    rows = table(spark, [(t, c) for c, ts in CORPUS.items() for t in ts] + [("", None)])
    rows = rows.union(rows.where("ticket_id < 2"))
    model = mo.fit_topics(rows, max_iter=5)
    coef = {r["idx"]: np.array(r["coef"]) for r in model.terms.collect()}
    terms = model.terms.select("block", "term", "idf", "idx", "coef")
    got = {r["ticket_id"]: r["sums"] for r in ft.sparse_sums(rows, terms, 5, keep=()).collect()}
    entries = ft.sparse_rows(rows, mo.vocabulary_of(model), keep=()).collect()
    assert len(got) == len(entries) == 26
    for r in entries:
        want = sum((coef[i] * v for i, v in zip(r["indices"], r["values"])), np.zeros(5))
        assert got[r["ticket_id"]] == pytest.approx(want.tolist())
    scored = mo.score_features(ft.sparse_rows(rows, mo.vocabulary_of(model), keep=()), model, keep=())
    for r in scored.collect():
        assert r["scores"] == pytest.approx((np.array(got[r["ticket_id"]]) + np.array(model.intercepts)).tolist())
