import math

import pytest
from pyspark.sql import functions as F

from triage import fixed_values as fv
from triage.functions import polarity as po
from triage.operators import sentiment as se


@pytest.fixture
def analyze(texts):
    def run(values, **options):
        rows = se.analyze_sentiment(texts(values), **options).collect()
        return [r["sentiment"] for r in sorted(rows, key=lambda r: r["ticket_id"])]

    return run


LABELS = [
    ("What a great release, I love it and thank you all!", "Positive"),
    ("The plan is renewed on the first of each month.", "Neutral"),
    ("We are somewhat disappointed with the last update.", "Frustrated"),
    ("This is absolutely horrible, I hate it, the worst tool ever.", "Angry"),
    ("They charged twice for one month.", "Frustrated"),
    ("Charged twice! Unacceptable, a scam!", "Angry"),
    ("Excellent support!", "Positive"),
]


def test_labels(analyze):
    assert [r["label"] for r in analyze([t for t, _ in LABELS])] == [x for _, x in LABELS]


def test_blank_and_null_are_neutral(analyze):
    for r in analyze(["", "   ", "\n\t", None]):
        assert r["label"] == "Neutral" and r["urgency_signals"] == []
        assert tuple(r["scores"]) == (0.0, 1.0, 0.0, 0.0, 0)


def test_signals_come_in_list_order_and_overlap(analyze):
    r = analyze(["A SCAM: double charged, and I am switching to a competitor"])[0]
    assert r["urgency_signals"] == [
        "double charged", "double charge", "switching to a competitor", "competitor", "scam",
    ]
    assert r["scores"]["urgency_hits"] == 5


def test_many_phrases_stay_in_range(analyze):
    r = analyze([", ".join(p for p, _ in fv.URGENCY_PHRASES)])[0]
    assert r["scores"]["urgency_hits"] == len(fv.URGENCY_PHRASES) == 35
    assert r["scores"]["compound"] >= -1.0 and r["label"] == "Angry"


def test_custom_phrases_replace_the_default(analyze, spark):
    r = analyze(["Thanks, really unacceptable"], phrases={"thanks": -0.8})[0]
    assert r["urgency_signals"] == ["thanks"]
    table = spark.createDataFrame(
        [(2, "b", -0.1), (1, "a", -0.2)], "phrase_no int, phrase string, delta double"
    )
    assert se.phrases_from_frame(table) == [("a", -0.2), ("b", -0.1)]
    assert analyze(["x"], phrases=[])[0]["urgency_signals"] == []


@pytest.mark.parametrize(
    "neg, hits, want",
    [(0.10, 0, 0.10), (0.40, 0, 0.40), (0.20, 1, 0.30), (0.20, 3, 0.50), (0.50, 5, 0.80),
     (0.95, 5, 1.0)],
)
def test_negative_intensity(spark, neg, hits, want):
    got = spark.range(1).select(se.negative_intensity(F.lit(neg), F.lit(hits))).first()[0]
    assert got == pytest.approx(want, abs=1e-9)


def test_label_thresholds(spark):
    cases = [
        (-0.51, 0.0, 0, "Angry"), (-0.50, 0.0, 0, "Frustrated"), (-0.0501, 0.0, 0, "Frustrated"),
        (-0.05, 0.0, 0, "Neutral"), (0.1999, 0.0, 0, "Neutral"), (0.20, 0.0, 0, "Positive"),
        (0.5, 0.35, 2, "Angry"), (0.5, 0.35, 1, "Positive"), (0.5, 0.34, 2, "Positive"),
    ]
    df = spark.createDataFrame(cases, "c double, n double, h int, want string")
    label = se.sentiment_label(F.col("c"), F.col("n"), F.col("h"))
    assert df.where(label != F.col("want")).count() == 0


LEXICON = po.Lexicon(
    {"good": 2.0, "bad": -2.0, "no": -1.0}, {"very": 0.293, "barely": -0.293}, ("not", "never")
)


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


@pytest.mark.parametrize(
    "text, total",
    [
        ("good", 2.0),
        ("It is good.", 2.0),
        ("very good", 2.293),
        ("very nice good", 2.0 + 0.293 * 0.95),
        ("very a b good", 2.0 + 0.293 * 0.9),
        ("very a b c good", 2.0),
        ("barely good", 1.707),
        ("very bad", -2.293),
        ("not good", 2.0 * -0.74),
        ("isn't good", 2.0 * -0.74),
        ("not a b good", 2.0 * -0.74),
        ("not a b c good", 2.0),
        ("so GOOD", 2.733),
        ("GOOD", 2.0),
        ("VERY good", 2.0 + 0.293 + 0.733),
        ("good but bad", 2.0 * 0.5 - 2.0 * 1.5),
        ("good!!", 2.0 + 2 * 0.292),
        ("bad!!!!!!", -2.0 - 4 * 0.292),
        ("good?", 2.0),
        ("good??", 2.0 + 2 * 0.18),
        ("good?????", 2.0 + 0.96),
        ("very very not good", ((2.0 * -0.74) - 0.293 * 0.95) - 0.293 * 0.9),
    ],
)
def test_polarity_rules(apply, text, total):
    got = apply(lambda c: po.polarity(c, LEXICON), [text])[0]
    assert got["compound"] == pytest.approx(compound(total), abs=2e-4)


def test_shares(apply):
    got = apply(lambda c: po.polarity(c, LEXICON), ["good bad a b", "", "a b"])
    assert (got[0]["neg"], got[0]["neu"], got[0]["pos"]) == (0.375, 0.25, 0.375)
    assert (got[1]["neu"], got[2]["neu"]) == (0.0, 1.0)


def test_emoticons_survive_and_punctuation_goes(apply):
    got = apply(po.tokens, ['(Hi), "WORLD"!! :) ok.'])[0]
    assert [(t["word"], t["caps"]) for t in got] == [
        ("(hi),", False), ("world", True), (":)", False), ("ok.", False),
    ]


def test_join_form_equals_array_form(spark, texts):
    values = [t for t, _ in LABELS] + ["", None, "not VERY good but BAD!!", "a " * 500 + "good"]
    df = texts(values)
    rows = [(w, "valence", v) for w, v in LEXICON.valence.items()]
    rows += [(w, "degree", v) for w, v in LEXICON.degree.items()]
    rows += [(w, "negation", 1.0) for w in LEXICON.negation]
    table = spark.createDataFrame(rows, "token string, kind string, value double")
    by_array = se.analyze_sentiment(df, lexicon=LEXICON).orderBy("ticket_id").collect()
    by_join = se.analyze_sentiment_by_join(df, table).orderBy("ticket_id").collect()
    assert [r["sentiment"] for r in by_array] == [r["sentiment"] for r in by_join]


def test_lexicon_is_sane():
    seed = po.seed_lexicon()
    assert len(seed.valence) > 80 and len(seed.degree) > 20 and "not" in seed.negation
    assert all(-4 <= v <= 4 for v in seed.valence.values())


def test_rules_of_two_words(texts):
    def compound(*values):
        rows = texts(values).select("ticket_id", po.polarity("text").alias("p")).collect()
        return [r["p"]["compound"] for r in sorted(rows, key=lambda r: r["ticket_id"])]

    rows = texts(["The service is kind of bad"]).select(po.polarity("text").alias("p")).first()
    assert rows["p"]["pos"] == 0.0 and rows["p"]["compound"] < 0
    sure, plain, least, at_least = compound("without doubt great", "great", "the least good", "at least good")
    assert sure > 0 and plain > 0 and least < 0 < at_least
    never_so, never, sort_of, full = compound("never so good", "never good", "a sort of good result", "a real of good result")
    assert never_so > 0 > never and sort_of < full
