import inspect
from collections import Counter

import pyarrow as pa
import pytest

from test_features import as_dict
from test_text import char_grams
from triage.functions import grams as gr
from triage.operators import features as ft

TEXTS = ["a bc bc", "", "x", "naïve 日本語 \U0001f600ok", "a\x00b a\x00b"]


def counted(grams):
    found = {}
    for a, b in grams.slices():
        text, key, count = grams.counted(a, b)
        for t, term, n in zip(text, grams.terms(key).to_pylist(), count):
            found[int(t) + a, term] = int(n)
    return found


@pytest.mark.parametrize("extra", ["", "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))])
def test_characters(extra, monkeypatch):
    """Of few and of so many different characters that five of them do not fit one number."""
    texts = [*TEXTS, extra]
    want = {(i, g): n for i, t in enumerate(texts) for g, n in Counter(char_grams(t)).items()}
    for size in (5, 1000):
        monkeypatch.setattr(gr, "SLICE_CHARS", size)
        grams = gr.CharGrams(pa.array(texts), 3, 5)
        assert (grams.heads is not None) == bool(extra)
        assert counted(grams) == want
        keys = gr.totals(grams)[0]
        names = [t.encode() for t in grams.terms(keys).to_pylist()]
        assert names == sorted(set(names))


def test_words():
    lists = [["bb", "aa", "bb", "aa"], [], ["aa"], ["cc", "aa"]]
    want = {(0, "aa"): 2, (0, "bb"): 2, (0, "bb aa"): 2, (0, "aa bb"): 1, (2, "aa"): 1, (3, "cc"): 1, (3, "aa"): 1, (3, "cc aa"): 1}
    grams = gr.WordGrams(pa.array(lists))
    assert counted(grams) == want
    keys, df, tf = gr.totals(grams)
    assert dict(zip(grams.terms(keys).to_pylist(), zip(df.tolist(), tf.tolist())))["aa"] == (3, 4)


def test_no_vocabulary_is_broadcast(spark, texts, monkeypatch):
    """However small the session's tables are, the term table goes to shards, never to the driver."""
    corpus = texts(["Refund the invoice", "the login page", "login the login page", "", None] * 3)
    monkeypatch.setattr(ft, "BROADCAST_BYTES", 700)
    model = ft.fit_tfidf(corpus)
    weights = ft.tfidf(corpus, model)
    assert "Broadcast" not in weights._jdf.queryExecution().executedPlan().toString()
    rows = as_dict(weights.collect())
    parts = ft.tfidf(corpus, model, combined="ticket").collect()
    assert sum(r["terms"] for r in parts) == len(rows)
    assert sum(r["total"] for r in parts) == pytest.approx(sum(rows.values()))
    by_term = ft.tfidf(corpus, model, combined="term").collect()
    assert len(by_term) > len({r["term"] for r in by_term})  # of several shards
    assert max(r["highest"] for r in by_term) == pytest.approx(max(rows.values()))
    assert "join_broadcast" not in inspect.getsource(ft)
