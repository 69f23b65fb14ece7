import hashlib
import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from triage.llm import mixing as X
from triage.llm.queries import BOOK_SOURCES, MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, op2_mixture

def by_source():
    return F.when(F.col("source").isin(*BOOK_SOURCES), "books").otherwise("web")



def fill(budget, children):
    """{name: part} by saturating children one after the other; children: {name: (cap, weight)}."""
    left = {k: v for k, v in children.items() if v[1] > 0}
    out = {k: 0 for k in children}
    rest = Fraction(budget)
    while left:
        level = max(rest, 0) / sum(w for _, w in left.values())
        full = [k for k, (cap, w) in left.items() if cap <= w * level]
        if not full:
            return out | {k: int(w * level) for k, (_, w) in left.items()}
        for k in full:
            out[k] = left.pop(k)[0]
            rest -= out[k]
    return out


def brute(rows, weights, share, epochs, seed):
    leaves = defaultdict(dict)
    for i, t, lang, source in rows:
        domain = "books" if source in BOOK_SOURCES else "web"
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        leaves[domain, lang or "unknown", source or "unknown"].setdefault(i, []).append(n)
    tokens = {k: sum(sum(x) for x in v.values()) for k, v in leaves.items()}
    w = lambda *p: weights.get("/".join(p), 1)
    usable = [k for k in leaves if w(*k) and w(*k[:2]) and w(k[0])]

    def caps(depth, parent):
        out = defaultdict(int)
        for k in usable:
            if k[: depth - 1] == parent:
                out[k[:depth]] += tokens[k] * epochs
        return {k: (c, w(*k)) for k, c in out.items()}

    budget = {}
    for d, b1 in fill(int(sum(tokens.values()) * share), caps(1, ())).items():
        for g, b2 in fill(b1, caps(2, d)).items():
            budget |= fill(b2, caps(3, g))
    out = []
    for k, b in budget.items():
        full, rest = divmod(b, tokens[k]) if tokens[k] else (0, b)
        ordered = sorted(leaves[k], key=lambda i: hashlib.md5(f"{seed}|{full}|{'' if i is None else i}".encode()).hexdigest())
        used, times = 0, {}
        for i in ordered:
            used += sum(leaves[k][i])
            times[i] = full + (used <= rest)
        out += [(i, *k, n, e) for i, t in times.items() for n in leaves[k][i] for e in range(t)]
    return sorted(out, key=str)


def result(df):
    return sorted(
        [
            (r["doc_id"], r["_domain"], r["lang"] or "unknown", r["source"] or "unknown", r["_tokens"], r["_epoch"])
            for r in df.collect()
        ],
        key=str,
    )


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = sorted([tuple(r) for r in op2_mixture(spark, sf).collect()], key=str)
    wanted = brute(rows, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    assert got == wanted and max(r[-1] for r in got) >= 1
    total = sum(len(re.findall(r"\S+", r[1] or "")) for r in rows)
    assert 0.5 * total <= sum(r[4] for r in got) <= MIX_SHARE * total


def test_shortages_go_to_siblings_first(docs):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(10), "en", "s1") for i in range(10)]
    rows += [(100 + i, words(10), "en", "s2") for i in range(100)]
    rows += [(300 + i, words(10), "de", "s1") for i in range(100)]
    taken = X.mix(docs(rows), F.lit("web"), {"web/en/s1": 9}, 0.4, 1)[0]
    sums = {(r["lang"], r["source"]): r["t"] for r in taken.groupBy("lang", "source").agg(F.sum("_tokens").alias("t")).collect()}
    # 840 of 2100 tokens: 420 a language; s1 has only 100, its sibling s2 takes the rest.
    assert sums == {("en", "s1"): 100, ("en", "s2"): 320, ("de", "s1"): 420}


def test_odd_rows(docs, odd_rows):
    for share, epochs in ((0.7, 1), (1.0, 3), (0.0, 2)):
        got = result(X.mix(docs(odd_rows, extra=True), by_source(), {"web/en/a": 5, "web/fr": 0}, share, epochs)[0])
        assert got == brute([(*r, None, None)[:4] for r in odd_rows], {"web/en/a": 5, "web/fr": 0}, share, epochs, 7)


def test_empty_table(docs):
    assert X.mix(docs([]), by_source(), {})[0].count() == 0


def test_native_plan(spark, no_python):
    no_python(op2_mixture(spark, "/root/testdata/sf0.001"))
