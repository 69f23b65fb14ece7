import random
import re
from collections import Counter

from pyspark.sql import functions as F

from triage.llm import line_runs as R
from triage.llm.queries import op5_line_runs


def brute(docs, min_words):
    """Deleted places: lines in a run of enough words that also starts at an earlier place."""
    lines = {}
    for i, t in docs:
        if t is not None and i not in lines:
            lines[i] = [x.strip(" \t\n\r\x0b\x0c") for x in t.split("\n")]
    order = sorted(lines, key=lambda i: (i is not None, i or 0))
    words = {i: [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in v] for i, v in lines.items()}
    gone = {i: set() for i in lines}
    first = {}
    for i in order:
        for s in range(len(lines[i])):
            for e in range(s + 1, len(lines[i]) + 1):
                run = tuple(lines[i][s:e])
                if run in first:
                    if first[run] != (i, s) and sum(words[i][s:e]) >= min_words:
                        gone[i] |= set(range(s, e))
                else:
                    first[run] = (i, s)
    return gone


def check(docs, rows, min_words):
    plain = [(r[0], r[1]) for r in rows]
    gone = brute(plain, min_words)
    out, _ = R.remove_repeated_lines(docs(rows, extra=True), min_words)
    got = out.collect()
    assert len(got) == len(rows)
    texts = dict(plain)
    for r in got:
        t = texts[r["doc_id"]]
        if t is None:
            assert r["text"] is None and r["_n_lines"] == 0
            continue
        kept = [x for n, x in enumerate(t.split("\n")) if n not in gone[r["doc_id"]]]
        assert r["text"] == "\n".join(kept), r["doc_id"]
        assert (r["_n_lines"], r["_n_removed"]) == (len(t.split("\n")), len(gone[r["doc_id"]]))
    return sum(map(len, gone.values()))


def test_equals_brute_force(docs):
    rng = random.Random(9)
    pool = ["a", "b c", "d e f", "", "g h i j k", " l m ", "n o p q r s t u v w x"]
    passages = [[rng.choice(pool) + str(rng.randint(0, 3)) for _ in range(9)] for _ in range(4)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randrange(9)
                lines += p[a : a + rng.randint(1, 9)]
            else:
                lines += [rng.choice(pool) for _ in range(rng.randint(1, 3))] + [f"own {i} {rng.random()}"]
        rows.append((i, "\n".join(lines)))
    rows += [(70, "x y\n" * 12), (71, "x y\n" * 20), (72, "\n".join(passages[0] * 3)), (73, "\n" * 40)]
    for least in (1, 4, 10):
        assert check(docs, rows, least) > 10


def test_odd_rows(docs, odd_rows):
    check(docs, odd_rows, 10)
    out, _ = R.remove_repeated_lines(docs(odd_rows))
    by = Counter((r["doc_id"], r["_n_removed"]) for r in out.collect())
    assert by[1, 0] == 1 and by[2, 1] == 2  # rows alike share the fate of their document


def test_null_id_comes_first(docs):
    line = " ".join("abcdefghijkl")
    out, _ = R.remove_repeated_lines(docs([(1, line), (None, line)]))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {None: line, 1: ""}


def test_empty_table(docs):
    assert R.remove_repeated_lines(docs([]))[0].count() == 0


def test_long_passage_in_many_documents(docs):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"start {i}\n{passage}\nend {i}") for i in range(40)]
    out = {r["doc_id"]: r["text"] for r in R.remove_repeated_lines(docs(rows))[0].collect()}
    assert out[0] == rows[0][1]
    assert all(out[i] == f"start {i}\nend {i}" for i in range(1, 40))


def test_native_plan_over_the_whole_table(spark, no_python):
    sf = "/root/testdata/sf0.001"
    df = op5_line_runs(spark, sf)
    no_python(df)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert df.count() == n and df.agg(F.sum("n_removed")).first()[0] > 0
