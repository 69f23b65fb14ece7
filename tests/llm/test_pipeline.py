"""The pipeline against plain versions of its stages, each on what the stage before kept."""

from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import test_line_runs
import test_mixing
import test_simhash

import corpus_pipeline as P
from triage.llm import language

SF = "/root/testdata/sf0.001"


def plain_language(model, text):
    words = language.words_of(text)
    if not words:
        return "und", 0.0
    total = model.word_scores(words).sum(0)
    soft = np.exp((total - total.max()) / np.sqrt(len(words)))
    return model.languages[int(np.argmax(total))], 1 / soft.sum()


def plain(spark, rows):
    """(doc_id, text, lang, source) rows through all stages; yields what each one keeps."""
    schema = "doc_id long, text string, lang string, source string"
    model = language.fit(spark.createDataFrame(rows, schema))
    rows = [r for r in rows if plain_language(model, r[1])[0] != "und" and plain_language(model, r[1])[1] >= P.LEAST_SCORE]
    yield rows
    gone = test_line_runs.brute([(r[0], r[1]) for r in rows], 10)
    cut = []
    for i, text, *rest in rows:
        left = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[i])
        if not gone[i] or left.strip():
            cut.append((i, left, *rest))
    yield (rows := sorted(cut))
    classes = test_simhash.brute_components([test_simhash.brute_print(r[1]) for r in rows])
    yield (rows := [r for k, r in enumerate(rows) if classes[k] == k])
    taken = test_mixing.brute(rows, P.WEIGHTS, P.SHARE, P.EPOCHS, P.SEED)
    kept = {x[0] for x in taken}
    yield (rows := [r for r in rows if r[0] in kept])


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage returns, by name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF).persist()
        out[name] = docs
    return out


def test_stages_equal_plain_versions(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect())
    wanted = dict(zip(("language", "line_runs", "simhash", "mixing"), plain(spark, rows)))
    for name, want in wanted.items():
        got = stages[name]
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        found = sorted(tuple(r) for r in got.select("doc_id", "text", "lang", "source").collect())
        assert found == sorted(want), name
        assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    original = sentencepiece.SentencePieceProcessor(model_proto=Path(P.PIECE_MODEL).read_bytes())
    texts = {r[0]: r[1] for r in wanted["mixing"]}
    last = {r["doc_id"]: r for r in stages["pieces"].collect()}
    assert last.keys() == texts.keys() and len(texts) > 100
    for i, text in texts.items():
        assert last[i]["ids"] == original.encode(text) and last[i]["n_tokens"] == len(last[i]["ids"])


def test_run_gives_the_last_stage(spark, stages):
    got = {r["doc_id"]: r["ids"] for r in P.run(spark, SF).collect()}
    assert got == {r["doc_id"]: r["ids"] for r in stages["pieces"].collect()}


def test_odd_and_empty_tables(spark, docs, odd_rows):
    for rows in (odd_rows, []):
        table = docs(rows)
        for _, stage in P.STAGES:
            table = stage(spark, table, SF)
        ids = [r["doc_id"] for r in table.collect()]
        assert len(ids) == len(set(ids))
        assert not {3, 4, 6} & set(ids)  # no letter, no language


def test_different_texts_without_or_under_one_id_stay(spark, docs):
    texts = [" ".join(f"{name}{i}" for i in range(20)) for name in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (9, texts[4])]
    kept = sorted((r["doc_id"], r["text"]) for r in P.dedup_near(spark, docs(rows), SF).fillna(-1, "doc_id").collect())
    assert kept == [(-1, texts[0]), (-1, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])]
