import math
import random
import re

from triage.llm import licenses as L


def brute(text, threshold=0.8):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    hits = []
    for n, line in enumerate(low.split("\n")):
        block = set(L.WORDS.findall(line))
        for label, t in sorted(L.TEMPLATES.items()):
            own = set(L.words_of(t))
            if len(own & block) >= math.ceil(threshold * len(own) - 1e-9):
                hits.append((n, label, len(own & block) / len(own)))
    score = 1.0 if starts else max((h[2] for h in hits), default=0.0)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), hits, score


def texts():
    rng = random.Random(1)
    out = ["CC BY cc-by  cc, by", "all rights reserved all rights reserved", "General\nPublic License"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(list(L.TEMPLATES.values())).split()
            words = [w for w in words if rng.random() < 0.93]
            words += rng.choices(["the", "of", "License", "any", "copy", "zzz"], k=rng.randint(0, 4))
            rng.shuffle(words)
            lines.append(" ".join(words))
        out.append("\n".join(lines))
    return out


def test_scan_equals_brute_force(docs, odd_rows):
    rows = [(100 + i, t) for i, t in enumerate(texts())] + odd_rows
    got = L.scan(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    wanted = {r[0]: brute(r[1]) for r in rows}
    assert sum(bool(w[5]) for w in wanted.values()) > 20
    for r in got:
        hits = [(h["line"], h["label"], h["containment"]) for h in r["hits"]]
        found = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], hits, r["score"])
        assert found == wanted[r["doc_id"]], r["doc_id"]


def brute_windows(text, templates, threshold=0.8):
    """By label the largest share of a template in any window of so many words as it takes, or in any line."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, lines = L.WORDS.findall(low), [L.WORDS.findall(x) for x in low.split("\n")]
    out = {}
    for label, t in templates.items():
        own, room = set(L.words_of(t)), math.ceil(len(L.words_of(t)) / threshold - 1e-9)
        blocks = [words[i : i + room] for i in range(len(words))] + lines
        best = max((len(own & set(b)) for b in blocks), default=0)
        if best >= math.ceil(threshold * len(own) - 1e-9):
            out[label] = best / len(own)
    return out


def wrapped_texts():
    """Notices with lost, added and repeated words, cut into lines anywhere, some with a line that holds most of one."""
    rng = random.Random(9)
    out = []
    for _ in range(250):
        words = []
        for _ in range(rng.randint(1, 3)):
            own = rng.choice(list(L.TEMPLATES.values())).split()
            words += [w for w in own if rng.random() < rng.choice([1.0, 0.9, 0.8])]
            words += rng.choices(["the", "of", "License", "any", "zzz"], k=rng.randint(0, 12))
        out.append("".join(w + rng.choice(["\n", " ", " ", " ", " "]) for w in words))
    return out


def test_windows_equal_brute_force(docs):
    rows = list(enumerate(wrapped_texts()))
    crossing = 0
    for r in L.scan(docs(rows)).collect():
        best = {}
        for h in [*r["hits"], *r["wrapped"]]:
            best[h["label"]] = max(best.get(h["label"], 0.0), h["containment"])
        assert best == brute_windows(rows[r["doc_id"]][1], L.TEMPLATES), r["doc_id"]
        crossing += bool({h["label"] for h in r["wrapped"]} - {h["label"] for h in r["hits"]})
    assert crossing > 50


def test_sql_knows_windows_too(spark, docs, odd_rows, tmp_path):
    import compare
    from triage.llm.queries import op10_licenses
    from triage.llm.sql import LICENSES

    table = docs(list(enumerate(wrapped_texts())) + [(1000 + i, t) for i, (_, t, *_) in enumerate(odd_rows)])
    table.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ok, message = compare.compare(spark, con, op10_licenses, LICENSES, str(tmp_path))
    assert ok, message


def test_null_and_empty_have_no_places(docs):
    for r in L.scan(docs([(1, None), (2, "")])).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["hits"], r["score"]) == (0, 0, None, [], 0.0)


def test_empty_table(docs):
    assert L.scan(docs([])).count() == 0


def test_prefixes_are_the_rarest_words():
    index = L.TemplateIndex({"t": "a b c d e"}, {"a": 5, "b": 1, "c": 9, "d": 9, "e": 9}, 0.8)
    assert index.keys == {"b", "a"}
    assert index.matches({"a", "c", "d", "e"}) == {"t": 0.8}
    assert index.matches({"c", "d", "e"}) == {}


def test_wrapped_notices_are_found(docs):
    long = " ".join(f"clause{i} of the licence" for i in range(200))
    templates = {**L.TEMPLATES, "long": long}
    rows, wanted = [], []
    for label, text in templates.items():
        words = text.split()
        for step in (len(words) // 2 + 1, 9):
            if step < len(words):
                parts = [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
                rows.append((len(rows), "# before it\n# " + "\n# ".join(parts) + "\nand behind it"))
                wanted.append(label)
    got = sorted(L.scan(docs(rows), templates=templates).collect(), key=lambda r: r["doc_id"])
    for r, label in zip(got, wanted, strict=True):
        found = {h["label"] for h in r["hits"]} | {h["label"] for h in r["wrapped"]}
        assert label in found, (label, found)
    assert sum(label in {h["label"] for h in r["wrapped"]} for r, label in zip(got, wanted)) > 10
    apart = ("zzz " * 100).join(f"{w}\n" for w in L.TEMPLATES["bsd"].split())
    assert not L.scan(docs([(1, apart)])).first()["wrapped"]
