r"""Text cleaning and tokens.

Java's ``\s``, ``\w`` and ``\b`` know only ASCII, while tickets are Unicode, so
the patterns below name their character classes. They read the same in RE2 but
for ``\x85``, which RE2 writes ``\x{85}``.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage import fixed_values as fv
from triage.functions.binding import column, let

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
SURPLUS = rf"{SPACE}{{2,}}|[\t-\r\x1c-\x1f\x85\p{{Z}}&&[^ ]]"
NON_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_]+"
# Possessive quantifiers and the look-behind change no match; they keep the time
# linear on long unbroken junk, where every start would else be tried again.
HTML_TAG = "<[^>]++>"
URL = rf"https?://{NON_SPACE}++|www\.{NON_SPACE}++"
WORD = r"\p{L}\p{N}_"
# An address begins where a word begins, or at a dot or dash that ends one.
EMAIL = (
    rf"(?:(?<![{WORD}])[{WORD}]|(?<=[{WORD}])[.-])[{WORD}.-]*+"
    rf"@[{WORD}.-]+\.[{WORD}]+"
)


def require_string(df: DataFrame, name: str) -> None:
    """Refuse a non-string text column when the plan is built, not per row."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.StringType):
        raise TypeError(f"column {name!r} must be a string, got {kind.simpleString()}")


# Every character of the class SPACE.
SPACES = "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch.isspace())


def strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends; looks at the ends only, unlike a pattern."""
    return F.trim(column(c), F.lit(SPACES))


def has_content(c: Column | str) -> Column:
    """True where the text holds anything but white space; stops at the first hit."""
    return F.coalesce(column(c).rlike(NON_SPACE), F.lit(False))


def _replaced(c: Column | str, pattern: str, *needed: str) -> Column:
    """Blanks for the matches of a pattern, none of which is without one of the strings ``needed``."""

    def of(text: Column) -> Column:
        there = reduce(Column.__or__, (F.contains(text, F.lit(n)) for n in needed))
        return F.when(there, F.regexp_replace(text, pattern, " ")).otherwise(text)

    return let(column(c), of)


def remove_html(c: Column | str) -> Column:
    return _replaced(c, HTML_TAG, "<")


def remove_urls(c: Column | str) -> Column:
    return _replaced(c, URL, "http", "www.")


def remove_emails(c: Column | str) -> Column:
    return _replaced(c, EMAIL, "@")


def normalize_whitespace(c: Column | str) -> Column:
    # A blank between words is left alone, since putting a blank for it costs most of the time.
    return F.trim(F.regexp_replace(column(c), SURPLUS, " "))


def clean_text(c: Column | str) -> Column:
    """Lower case without markup, links, addresses and surplus white space."""
    bare = remove_emails(remove_urls(remove_html(F.lower(column(c)))))
    return normalize_whitespace(bare)


def clean_text_or_empty(c: Column | str) -> Column:
    return F.coalesce(clean_text(c), F.lit(""))


def assemble_text(subject: Column | str, body: Column | str) -> Column:
    """Subject, blank line, body; nulls count as empty."""
    parts = [strip(F.coalesce(column(c), F.lit(""))) for c in (subject, body)]
    return strip(F.concat_ws("\n\n", *parts))


def rule_text(*columns: Column | str) -> Column:
    """Lower-cased fields in one string; null and empty fields leave no separator."""
    cols = [column(c) for c in columns]
    return F.concat_ws(" \n ", *[F.when(c != "", F.lower(c)) for c in cols])


def words(c: Column | str) -> Column:
    """Pieces between white space."""
    return F.array_remove(F.split(column(c), f"{SPACE}+"), "")


def word_count(c: Column | str) -> Column:
    """Number of pieces between white space, without building the words."""
    return F.regexp_count(column(c), F.lit(f"{NON_SPACE}+"))


@cache
def accent_table() -> tuple[str, str]:
    """Characters to replace and their plain forms, for ``translate``.

    Follows compatibility decomposition: a character is replaced where its form
    without combining marks is one character, and combining marks are dropped.
    """
    source, target, dropped = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.combining(ch):
            dropped.append(ch)
            continue
        plain = "".join(
            p for p in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(p)
        )
        if len(plain) == 1 and plain != ch:
            source.append(ch)
            target.append(plain)
    return "".join(source + dropped), "".join(target)


@cache
def long_forms() -> tuple[str, tuple[str, ...]]:
    """Characters whose plain form is not one character, and those forms; no Hangul syllables."""
    source, forms = [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.combining(ch) or HANGUL <= code < HANGUL + 11172:
            continue
        plain = "".join(
            p for p in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(p)
        )
        if len(plain) != 1:
            source.append(ch)
            forms.append(plain)
    return "".join(source), tuple(forms)


# Hangul syllables are numbered from here: 19 first parts by 21 middle parts by 28 last ones.
HANGUL = 0xAC00


def _hangul_parts(ch: Column) -> Column:
    """The two or three parts a Hangul syllable is made of."""

    def part(first: int, n: int, at: Column) -> Column:
        letters = "".join(chr(first + i) for i in range(n))
        return F.substr(F.lit(letters), at + 1, F.lit(1))

    def parts(no: Column) -> Column:
        last = F.pmod(no, F.lit(28))
        return F.concat(
            part(0x1100, 19, F.floor(no / 588).cast("int")),
            part(0x1161, 21, F.floor(F.pmod(no, F.lit(588)) / 28).cast("int")),
            F.when(last > 0, part(0x11A8, 27, last - 1)).otherwise(""),
        )

    return let(F.ascii(ch) - HANGUL, parts)


def _has_long_form(text: Column) -> Column:
    """Whether a text holds a character of ``long_forms`` or a Hangul syllable.

    A pattern of so many ranges tries them one by one; characters are looked up instead.
    """
    found = F.translate(text, long_forms()[0], "") != text
    return found | text.rlike(rf"[\x{{{HANGUL:X}}}-\x{{{HANGUL + 11171:X}}}]")


def strip_accents(c: Column | str) -> Column:
    """Compatibility decomposition without combining marks; pure ASCII text is passed through.

    Most characters become one other or vanish, which is one ``translate``. Only texts that hold
    a character with a longer form are taken apart.
    """
    source, target = accent_table()
    longer, forms = long_forms()

    def plain(ch: Column) -> Column:
        at = F.instr(F.lit(longer), ch)
        syllable = (ch >= chr(HANGUL)) & (ch <= chr(HANGUL + 11171)) & (F.length(ch) == 1)
        return (
            F.when(ch <= "\x7f", ch)
            .when(syllable, _hangul_parts(ch))
            .when(at > 0, F.get(F.lit(list(forms)), at - 1))
            .otherwise(ch)
        )

    def expand(text: Column) -> Column:
        taken_apart = F.array_join(F.transform(F.split(text, ""), plain), "")
        return F.when(_has_long_form(text), taken_apart).otherwise(text)

    text = column(c)
    # More bytes than code points: not all is ASCII.
    return F.when(
        F.octet_length(text) > F.char_length(text), let(F.translate(text, source, target), expand)
    ).otherwise(text)


def word_tokens(c: Column | str) -> Column:
    """Words of two or more word characters, accents stripped."""
    pieces = F.split(strip_accents(c), NON_WORD)
    return F.filter(pieces, lambda w: F.length(w) >= 2)


def word_string(c: Column | str) -> Column:
    """What ``word_tokens`` are pieces of: runs of word characters, one blank apart, those of one character too."""
    return F.regexp_replace(strip_accents(c), NON_WORD, " ")


def word_ngrams(c: Column | str, span: tuple[int, int] = fv.WORD_NGRAMS) -> Column:
    """All runs of ``span`` tokens, joined by a blank: single words first, then pairs."""
    low, high = span

    def runs(tokens: Column, n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.sequence(F.lit(0), F.size(tokens) - n)
        joined = F.transform(
            starts, lambda i: F.concat_ws(" ", F.slice(tokens, i + 1, F.lit(n)))
        )
        return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))

    return let(
        word_tokens(c),
        lambda tokens: F.concat(*[runs(tokens, n) for n in range(low, high + 1)]),
    )


def ngrams_of_word(word: Column, span: tuple[int, int] = fv.CHAR_NGRAMS) -> Column:
    """Character n-grams of one word padded with a blank on each side."""
    low, high = span

    def grams(padded: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        cut = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, cut).otherwise(F.array().cast("array<string>"))

    return let(
        F.concat(F.lit(" "), word, F.lit(" ")),
        lambda padded: F.concat(*[grams(padded, n) for n in range(low, high + 1)]),
    )


def char_ngrams(c: Column | str, span: tuple[int, int] = fv.CHAR_NGRAMS) -> Column:
    """Character n-grams that do not cross word bounds."""
    return F.flatten(F.transform(words(c), lambda w: ngrams_of_word(w, span)))


def char_ngram_bag(c: Column | str, span: tuple[int, int] = fv.CHAR_NGRAMS) -> Column:
    """``char_ngrams`` in no particular order, found by one pattern per length.

    With words set two blanks apart, an n-gram inside word bounds is any n characters
    whose inner ones are not blank. A look-ahead finds them at every place; it may not
    begin inside a surrogate pair.
    """
    low, high = span
    spaced = F.concat(F.lit(" "), F.replace(normalize_whitespace(c), F.lit(" "), F.lit("  ")), F.lit(" "))

    def grams(padded: Column, n: int) -> Column:
        inner = "[^ ]" * (n - 2)
        return F.regexp_extract_all(
            padded, F.lit(rf"(?s)(?=([^\uDC00-\uDFFF]{inner}.))"), F.lit(1)
        )

    return let(spaced, lambda p: F.concat(*[grams(p, n) for n in range(low, high + 1)]))


def term_counts(terms: Column, **constants: Column) -> Column:
    """``array<struct<…constants, term, tf>>`` of an array of terms, inside the row.

    The terms are sorted; a run of equal neighbours is one term and its length
    the count. No shuffle is needed, whatever the table size.
    """

    def runs(s: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(
            positions, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )
        return let(starts, lambda st: F.transform(st, lambda at, k: run(s, st, at, k)))

    def run(s: Column, starts: Column, at: Column, k: Column) -> Column:
        return F.struct(
            *[value.alias(name) for name, value in constants.items()],
            F.get(s, at).alias("term"),
            (F.coalesce(F.get(starts, k + 1), F.size(s)) - at).alias("tf"),
        )

    # Only the array's length decides, so no terms give no runs.
    return let(
        F.sort_array(terms),
        lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.slice(runs(F.array(F.lit(""))), 1, 0)),
    )
