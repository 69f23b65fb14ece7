import math
import random
import re
from collections import Counter

import pytest

from triage.llm import ranked_search as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, rank int, score string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, most=20):
    docs = [(i, Counter(w), len(w)) for i, t, *_ in rows if (w := words(t))]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked = Counter(words(text))
        scored = []
        for i, c, size in docs:
            m = 75 + (25 * size * n) // total
            s = sum(
                k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, k in asked.items()
                if t in c
            )
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        scored.sort()
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(scored[:most])]
    return sorted(out, key=repr)


def made(n=700, seed=1):
    rng = random.Random(seed)
    common = ["the", "of", "AND", "to", "été", "in", "it"]
    rare = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 30, 80, 200])
        text = " ".join(rng.choice(common) if rng.random() < 0.6 else rare[int(300 * rng.random() ** 3)] for _ in range(size))
        rows.append((i * 2, text.replace(" to ", ", To: ")))
    rows += [(r[0] + 1, rows[5][1]) for r in rows[: n // 3]]  # a third of all are copies
    items = []
    for k in range(25):
        items.append((k, " ".join(rng.choice(common + rare[:40] + rare[250:]) for _ in range(rng.choice([1, 2, 6, 25])))))
    return rows, items


def ask(docs, rows, spark, items, **how):
    df, _ = R.search(docs(rows, extra=True), spark.createDataFrame([(*x, None, "s") for x in items], ITEMS), **how)
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("shard", "window", "short"), [(1_000_000, 512, 0.25), (900, 16, 0.25), (5000, 7, 0.0), (3000, 64, 10.0)])
def test_equals_brute_force(spark, docs, monkeypatch, shard, window, short):
    rows, items = made()
    monkeypatch.setattr(R, "SHARD", shard)
    monkeypatch.setattr(R, "WINDOW", window)
    monkeypatch.setattr(R, "SHORT_SHARE", short)
    best = brute(rows, items)
    # in one process, where the settings hold, and as the job
    assert plain(rows, items) == best
    assert ask(docs, rows, spark, items) == best


def plain(rows, items, most=20):
    """The shards and bests of the operator without Spark; counts skipped windows by being right."""
    import numpy as np
    import pyarrow as pa

    chunk = [{"item_id": i, "text": t} for i, t in items]
    known, counted = R._chunk_words(chunk)
    index, df, lengths = [], Counter(), []
    for i, t, *_ in rows:
        own = R.terms((t or "").encode())
        if own:
            c = {known[w]: k for w, k in Counter(own).items() if w in known}
            df.update(c.keys())
            lengths.append(len(own))
            index.append({"doc_id": i, "n": len(own), "terms": list(c), "tfs": list(c.values())})
    n, total = len(index), sum(lengths)
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
    best = [R.Best(most) for _ in items]
    batches = [pa.RecordBatch.from_pylist(index[a : a + 150], schema=kind) for a in range(0, len(index), 150)]
    for ids, shard in R._shards(iter(batches), n, total):
        for c, top in zip(counted, best, strict=True):
            own = sorted((known[t], k * R.weight(n, df[known[t]])) for t, k in c.items() if known[t] in df)
            top.ids = ids
            shard.search(R.Item(np.array([t for t, _ in own], dtype=np.int64), np.array([w for _, w in own], dtype=np.int64)), top)
    out = []
    for (item, _), top in zip(items, best, strict=True):
        out += [(item, k + 1, i, s) for k, (i, s) in enumerate(zip(top.found.tolist(), top.scores.tolist(), strict=True))]
    return sorted(out, key=repr)


def test_many_chunks_and_odd_rows(spark, docs, odd_rows, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_BYTES", 60)
    items = [(1, "one TWO nine"), (2, ""), (3, None), (4, "absent"), (5, "12 éß Éß \U0001f600"), (None, "onze"), (7, "alpha0 one one")]
    assert ask(docs, odd_rows, spark, [*items, items[0]]) == brute(odd_rows, items)


def test_empty_tables(spark, docs):
    assert ask(docs, [], spark, [(1, "a")]) == []
    assert ask(docs, [(1, "a")], spark, []) == []
    assert ask(docs, [(1, None), (2, "...")], spark, [(1, "a")]) == []
