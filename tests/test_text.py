import re
import sys
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from triage.functions import text as tx
from triage.operators import features as ft

CLEANED = [
    ("Good Morning", "good morning"),
    ("   WIDE    gaps  ", "wide gaps"),
    ("<i>slanted</i> words", "slanted words"),
    ("look at https://a.example/b?c=d please", "look at please"),
    ("www.shop.example page", "page"),
    ("write to me.too@mail.example now", "write to now"),
    ("", ""),
    (" \n\t ", ""),
    ("one\ntwo\tthree", "one two three"),
    ("<a href='u'>press</a>", "press"),
    ("Mail: X.Y-z@sub.mail.example.org!", "mail: !"),
    ("HTTPS://UPPER.example/PATH", ""),
    ("<script>run(2)</script>rest", "run(2) rest"),
    ("Ünïcode 😀 kept", "ünïcode 😀 kept"),
    ("http://a.example then www.b.example end", "then end"),
    ("a < b but c > d", "a d"),
    (" no break　spaces\u0085", "no break spaces"),
    ("&amp; stays", "&amp; stays"),
    ("trailing@ sign and @leading", "trailing@ sign and @leading"),
    ("x@a.b.@_c.d x@a.be-@f.g", ""),
]


def test_clean_text(apply):
    assert apply(tx.clean_text, [raw for raw, _ in CLEANED]) == [out for _, out in CLEANED]


def test_clean_text_twice_changes_nothing(apply):
    raw = ["Hi   <b>All</b>  see https://x.example and  me@mail.example!"]
    once = apply(tx.clean_text, raw)
    assert apply(tx.clean_text, once) == once


def test_single_steps_replace_by_one_blank_and_do_not_trim(apply):
    assert apply(tx.remove_html, ["<p>y</p>"]) == [" y "]
    assert apply(tx.remove_urls, ["at https://b.example end"]) == ["at   end"]
    assert apply(tx.remove_emails, ["yo a@b.co end"]) == ["yo   end"]
    assert apply(tx.normalize_whitespace, ["  p\n\nq\tr  "]) == ["p q r"]


def test_nulls(apply):
    assert apply(tx.clean_text, [None]) == [None]
    assert apply(tx.clean_text_or_empty, [None]) == [""]


def test_non_string_column_is_refused(spark):
    with pytest.raises(TypeError):
        tx.require_string(spark.range(1), "id")
    with pytest.raises(TypeError):
        ft.count_terms(spark.range(1).selectExpr("id ticket_id", "id text"))


def plain_clean(raw: str) -> str:
    """The cleaning rules, said in Python."""
    s = raw.lower()
    s = re.sub(r"<[^>]+>", " ", s)
    s = re.sub(r"https?://\S+|www\.\S+", " ", s)
    s = re.sub(r"\b[\w.-]+@[\w.-]+\.\w+\b", " ", s)
    return re.sub(r"\s+", " ", s).strip()


PIECES = st.sampled_from(
    ["<", ">", "<b>", "@", ".", "-", "_", "http://", "https://", "www.", "a", "B", "é", "9", " ",
     "\n", " ", " ", "\x1c", "½", "x@y.z", "word", "!", "́", "ß", "中"]
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=40, max_size=60))
def test_clean_text_equals_the_python_rules(apply, values):
    assert apply(tx.clean_text, values) == [plain_clean(v) for v in values]


def test_long_junk_is_cleaned_in_linear_time(apply):
    junk = "a" * 300_000
    assert apply(tx.clean_text, [junk, "<" + junk, junk + "@" + junk])[0] == junk


def test_strip_and_assemble(spark):
    df = spark.createDataFrame(
        [(" a ", "\n b "), (None, "b"), ("a", None), (" ", "\t"), (None, None)],
        "subject string, body string",
    )
    got = [r[0] for r in df.select(tx.assemble_text("subject", "body")).collect()]
    assert got == ["a\n\nb", "b", "a", "", ""]


def test_word_count(apply):
    values = ["", "  ", "one", " two  words\n", "a b\u0085c"]
    assert apply(tx.word_count, values) == [len(v.split()) for v in values]


def test_words_equal_split(apply):
    values = ["", "  lead", "trail ", "a\tb  c"]
    assert apply(tx.words, values) == [v.split() for v in values]


def test_accents_of_every_code_point(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    table = spark.createDataFrame([(f"a{chr(c)}b",) for c in codes], "text string")
    for r in table.select("text", tx.strip_accents("text").alias("out")).toPandas().itertuples():
        parts = unicodedata.normalize("NFKD", r.text)
        assert r.out == "".join(p for p in parts if not unicodedata.combining(p)), ascii(r.text)


def test_longer_forms_are_words(apply):
    text = "the ﬁle is 한 국어 ½ cup ™ naïve café ǆ"
    expected = [unicodedata.normalize("NFKD", w) for w in ("한", "국어")]
    assert apply(tx.word_tokens, [text]) == [
        ["the", "file", "is", *expected, "cup", "TM", "naive", "cafe", "dz"]
    ]


def test_word_tokens_and_ngrams(apply):
    assert apply(tx.word_tokens, ["Café au lait, a 2fa x_y ½½"]) == [
        ["Cafe", "au", "lait", "2fa", "x_y", "21"]
    ]
    assert apply(tx.word_ngrams, ["red green blue", "one", "", "a b c"]) == [
        ["red", "green", "blue", "red green", "green blue"],
        ["one"],
        [],
        [],
    ]


def char_grams(text):
    """Character n-grams inside word bounds, said in Python."""
    out = []
    for word in text.split():
        padded = f" {word} "
        for n in (3, 4, 5):
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


def test_char_ngrams(apply):
    values = ["hi", "a", "", "log in é", "longer words 😀x"]
    assert apply(tx.char_ngrams, values) == [char_grams(v) for v in values]


def test_term_counts(apply):
    got = apply(lambda c: tx.term_counts(tx.char_ngrams(c)), ["aaa aaa", "", "ab"])
    for value, counted in zip(["aaa aaa", "", "ab"], got):
        grams = char_grams(value)
        assert {r["term"]: r["tf"] for r in counted} == {g: grams.count(g) for g in set(grams)}


def test_char_ngram_bag_holds_the_same_ngrams(apply):
    values = ["hi", "a", "", "  ", "log in é", "longer words 😀x 😀😀 x😀y", "a\tb  c\u0085dd", "x" * 9]
    values += [raw for raw, _ in CLEANED]
    got = apply(tx.char_ngram_bag, values)
    assert [sorted(g) for g in got] == [sorted(char_grams(v)) for v in values]


def test_surplus_white_space_and_needed_strings(apply):
    texts = ["a b", "a  b", " a\tb\n", "a   b", "a　b", "x@y.zz z", "www.a b", "<b>a</b>b", None]
    assert apply(tx.clean_text, texts) == ["a b", "a b", "a b", "a b", "a b", "z", "b", "a b", None]


def test_long_forms_are_found_without_a_pattern_of_ranges(apply):
    from pyspark.sql import functions as F

    texts = ["ﬁsh", "½ m", "한글", "é", "plain", "a한"]
    assert apply(lambda c: tx._has_long_form(F.col(c)), texts) == [True, True, True, False, False, True]
