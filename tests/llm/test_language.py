import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triage.llm import language as G
from triage.llm.queries import op6_language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op6_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.filter("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert r[0] > 150 and r[1] >= 0.98
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def model_of(languages, words, ngrams):
    """A model from scores of words and of n-grams."""
    keys = np.concatenate([G.hashes(list(words), 0), *(G.hashes([g], len(g)) for g in ngrams)])
    scores = np.array([*words.values(), *ngrams.values()])
    order = np.argsort(keys)
    return G.LanguageModel(languages, [1.0] * len(languages), keys[order], scores[order])


def test_words_first_then_longest_known_grams():
    m = model_of(["a", "b"], {"house": (-1.0, -9.0)}, {"ho": (-2.0, -4.0), "use": (-3.0, -1.0), "x": (-5.0, -6.0)})
    words = {
        "house": [-1.0, -9.0],
        "houses": [-3.0, -1.0],  # "use" is longer than "ho"
        "hoax": [-2.0, -4.0],
        "xxxx": [-5.0, -6.0],
        "qqq": [0.0, 0.0],
        "houseuse": [-3.0, -1.0],
    }
    assert m.word_scores(list(words)).tolist() == list(words.values())


def test_words_are_letters_with_their_marks():
    assert G.words_of("½ ² Ⅷ 12 _ - ́") == []
    assert G.words_of("Haus2 don't ÉTÉ") == ["haus", "don", "t", "été"]
    assert G.words_of("हिन्दी x́y²z") == ["हिन्दी", "x́y", "z"]
    assert G.words_of(None) == G.words_of("") == []


def brute(rows, texts, most=None, min_count=3):
    """Languages and scores of texts, learned from (text, lang) rows the plain way."""
    words = re.compile(r"[a-zà-ÿ]+")
    languages = sorted({lang for _, lang in rows})
    seen = {x: Counter() for x in languages}
    for text, lang in rows:
        for w in words.findall(text.lower()):
            seen[lang][0, w] += 1
            for n in range(1, 6):
                own = f"^{w}$" if n > 1 else w
                for i in range(len(own) - n + 1):
                    seen[lang][n, own[i : i + n]] += 1
    kept = {x for x, n in sum(seen.values(), Counter()).items() if n >= min_count}
    logs = {}
    for kind in range(6):
        own = [x for x in kept if x[0] == kind]
        totals = [sum(seen[lang][x] for x in own) for lang in languages]
        for x in own:
            logs[x] = [
                math.log((seen[lang][x] + 0.1 * t / max(totals)) / (t + 0.1 * t / max(totals) * len(own)))
                for lang, t in zip(languages, totals, strict=True)
            ]
    out = []
    for text in texts:
        own = words.findall(text.lower())
        total = [0.0] * len(languages)
        for w in own:
            found = [logs[0, w]] if (0, w) in logs else []
            for n in range(5, 0, -1):
                if found:
                    break
                g = f"^{w}$" if n > 1 else w
                found = [logs[n, g[i : i + n]] for i in range(len(g) - n + 1) if (n, g[i : i + n]) in logs]
            for f in found:
                total = [a + b / len(found) for a, b in zip(total, f, strict=True)]
        if not own:
            out.append(("und", 0.0))
            continue
        best = max(range(len(languages)), key=lambda j: (total[j], -j))
        out.append((languages[best], 1 / sum(math.exp((t - total[best]) / math.sqrt(len(own))) for t in total)))
    return out


@pytest.mark.parametrize("parts", [1, 50])
def test_equals_brute_force(spark, parts):
    rng = random.Random(7)
    stems = {"x": ["haus", "baum", "über", "kind"], "y": ["maison", "été", "arbre", "enfant"], "z": ["house", "tree", "child", "over"]}
    ends = ["", "s", "en", "e", "ing"]

    def text(lang):
        own = stems[lang] + rng.choice(list(stems.values()))[:1]
        return " ".join(rng.choice(own) + rng.choice(ends) for _ in range(rng.randint(0, 12)))

    rows = [(i, text(lang), lang) for i in range(240) for lang in [rng.choice("xxxxyz")]]
    asked = [(1000 + i, text(rng.choice("xyz")) + rng.choice(["", " 12", " qqq wwww"])) for i in range(120)]
    model = G.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts))
    got = G.predict(spark.createDataFrame(asked, "doc_id long, text string").repartition(parts), model).collect()
    want = dict(zip([i for i, _ in asked], brute([r[1:] for r in rows], [t for _, t in asked]), strict=True))
    for r in got:
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-5, (r, lang, score)
    assert len(got) == len(asked)


def test_confident_keeps_all_columns(docs, odd_rows):
    table = docs(odd_rows, extra=True)
    kept = G.confident(table, G.fit(table, min_count=1), 0.0)
    assert kept.schema == table.schema
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 2, 5, 7]


def test_rows_without_ids_are_chosen_by_their_texts(docs):
    table = docs([(None, f"wort{i} wort haus", "x", "s") for i in range(300)])
    assert G.fit(table, max_docs_per_language=100, min_count=1).languages == ["x"]


def test_odd_rows(docs, odd_rows):
    table = docs(odd_rows, extra=True)
    rows = G.predict(table, G.fit(table, min_count=1)).collect()
    assert len(rows) == len(odd_rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == "en"
    for i in (3, 4, 6):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[7]["lang_pred"] == "fr"


def test_unseen_letters_get_the_most_frequent_language(docs):
    table = docs([(1, "aa aa aa", "x", "s"), (2, "bb bb bb", "y", "s"), (3, "bb bb", "y", "s")])
    r = G.predict(docs([(9, "你好")]), G.fit(table, min_count=1)).first()
    assert (r["lang_pred"], r["score"]) == ("y", 0.5)


def test_nothing_learned(docs):
    model = G.fit(docs([]))
    assert G.predict(docs([]), model).count() == 0
    assert G.predict(docs([(1, "some words")]), model).first()["lang_pred"] == "und"


def test_lang_and_source_are_not_inputs(docs):
    table = docs([(i, "the house of", "en", "s") for i in range(5)] + [(i, "la maison de", "fr", "s") for i in range(5, 10)])
    model = G.fit(table, min_count=1)
    a = G.predict(docs([(1, "the house", "fr", "z")]), model).first()
    b = G.predict(docs([(1, "the house", None, None)]), model).first()
    assert a == b and a["lang_pred"] == "en"
