"""Word polarity of a text: negative, neutral, positive share and a compound score.

Follows the five rules of Hutto & Gilbert, "VADER: A Parsimonious Rule-based Model
for Sentiment Analysis of Social Media Text" (ICWSM 2014): exclamation and question
marks, capitals, degree words, "but", and negation within three words. The word list
of that paper is not shipped; ``data/seed_lexicon.csv`` is a small one of our own and
any other can be given, so scores agree with published ones in sign, not in digits.
"""

from __future__ import annotations

import csv
import string
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from triage.functions import text as tx
from triage.functions.binding import column, let

# Fixed values of the rules.
CAPITALS = 0.733
NEGATION = -0.74
NEVER_BEFORE, RAISED = ("so", "this"), 1.25
DAMPING, DAMPED = ("kind", "sort"), -0.293
LEAST_AFTER = ("at", "very")
DISTANCE = {1: 1.0, 2: 0.95, 3: 0.9}
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MAX_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
ALPHA = 15.0

PUNCTUATION = string.punctuation
# Punctuation at an end of a piece.
PUNCTUATED = r"^[!-/:-@\[-`{-~]|[!-/:-@\[-`{-~]\z"


@dataclass(frozen=True)
class Lexicon:
    """Word valences, degree words and negations, all lower case."""

    valence: dict[str, float] = field(default_factory=dict)
    degree: dict[str, float] = field(default_factory=dict)
    negation: tuple[str, ...] = ()

    @staticmethod
    def from_rows(rows) -> Lexicon:
        """From ``(token, kind, value)`` rows; kinds are valence, degree, negation."""
        found: dict[str, dict[str, float]] = {"valence": {}, "degree": {}, "negation": {}}
        for token, kind, value in rows:
            found[kind][token] = float(value)
        return Lexicon(found["valence"], found["degree"], tuple(found["negation"]))


@cache
def seed_lexicon() -> Lexicon:
    path = Path(__file__).resolve().parents[1] / "data" / "seed_lexicon.csv"
    with path.open(encoding="utf-8", newline="") as f:
        return Lexicon.from_rows(
            (r["token"], r["kind"], r["value"]) for r in csv.DictReader(f)
        )


def tokens(text: Column | str) -> Column:
    """``array<struct<word, caps>>`` of the pieces between white space.

    Punctuation at the ends is dropped unless two characters or fewer would remain,
    which keeps emoticons.
    """

    def bare(piece: Column) -> Column:
        # Most pieces are only looked at, which takes less than trimming them.
        trimmed = F.trim(piece, F.lit(PUNCTUATION))
        return F.when(piece.rlike(PUNCTUATED) & (F.length(trimmed) > 2), trimmed).otherwise(piece)

    def one(w: Column) -> Column:
        low = F.lower(w)
        return F.struct(low.alias("word"), ((low != w) & (F.upper(w) == w)).alias("caps"))

    return F.transform(F.transform(tx.words(text), bare), one)


def _find(word: Column, known: dict[str, float]) -> Column:
    """Entry of a word, by its first letter and then by the word.

    A literal map is searched from front to back; the two steps keep that short.
    """
    if not known:
        return F.lit(None).cast("double")
    by_letter: dict[str, list[Column]] = {}
    for w, value in known.items():
        by_letter.setdefault(w[0], []).extend([F.lit(w), F.lit(value)])
    letters = [x for k, v in by_letter.items() for x in (F.lit(k), F.create_map(*v))]
    words = F.try_element_at(F.create_map(*letters), F.substring(word, 1, 1))
    return F.try_element_at(words, word)


@dataclass(frozen=True)
class Modifiers:
    """How to tell a token's degree and whether it negates."""

    degree: Callable[[Column], Column]
    negates: Callable[[Column], Column]

    @staticmethod
    def from_lexicon(lexicon: Lexicon) -> Modifiers:
        negations = F.array(*[F.lit(w) for w in lexicon.negation]).cast("array<string>")
        return Modifiers(
            lambda t: F.coalesce(_find(t["word"], lexicon.degree), F.lit(0.0)),
            lambda t: F.array_contains(negations, t["word"])
            | F.contains(t["word"], F.lit("n't")),
        )

    @staticmethod
    def from_fields() -> Modifiers:
        return Modifiers(lambda t: t["degree"], lambda t: t["negates"])


def rate(toks: Column, lexicon: Lexicon) -> Column:
    """Add each token's valence, null where the lexicon has none."""
    return F.transform(
        toks,
        lambda t: F.struct(
            t["word"].alias("word"),
            t["caps"].alias("caps"),
            _find(t["word"], lexicon.valence).alias("valence"),
        ),
    )


def rated(token: Column, valence: Column, degree: Column, negates: Column) -> Column:
    """A token with its lexicon entries, as joined from a table."""
    return F.struct(
        token["word"].alias("word"),
        token["caps"].alias("caps"),
        valence.alias("valence"),
        F.coalesce(degree, F.lit(0.0)).alias("degree"),
        (F.coalesce(negates, F.lit(False)) | F.contains(token["word"], F.lit("n't"))).alias(
            "negates"
        ),
    )


def _value(
    toks: Column, at: Column, some_caps: Column, but_at: Column, modifiers: Modifiers
) -> Column:
    """Valence of the token at ``at`` after capitals, degree words, negation and "but"."""
    this = F.get(toks, at)

    def with_sign_of(v: Column, size: Column) -> Column:
        return F.when(v > 0, size).otherwise(-size)

    def looked_back(value: Column, distance: int) -> Column:
        def weigh(v: Column) -> Column:
            return let(F.get(toks, at - distance), lambda prev: changed(v, prev))

        def changed(v: Column, prev: Column) -> Column:
            plain = (at >= distance) & prev["valence"].isNull()
            return F.when(plain, let(modifiers.degree(prev), lambda d: turned(v, prev, d))).otherwise(
                v
            )

        def turned(v: Column, prev: Column, degree: Column) -> Column:
            loud = F.when(
                prev["caps"] & some_caps & (degree != 0), with_sign_of(v, F.lit(CAPITALS))
            ).otherwise(F.lit(0.0))
            shifted = v + (F.when(v < 0, -degree).otherwise(degree) + loud) * DISTANCE[distance]
            turned_by = F.when(modifiers.negates(prev), NEGATION).otherwise(F.lit(1.0))
            if distance > 1:
                between = [word(k) for k in range(1, distance)]
                raised = (prev["word"] == "never") & any_of(between, NEVER_BEFORE)
                assured = (prev["word"] == "without") & any_of(between, ("doubt",))
                turned_by = F.when(raised, RAISED).when(assured, 1.0).otherwise(turned_by)
            out = shifted * turned_by
            if distance == 3:
                for k in (1, 2):
                    pair = word(k + 1).isin(*DAMPING) & (word(k) == "of")
                    out = out + F.when(pair, DAMPED).otherwise(F.lit(0.0))
            return out

        return let(value, weigh)

    def word(back: int) -> Column:
        return F.coalesce(F.get(toks, at - back)["word"], F.lit(""))

    def any_of(found: list[Column], wanted: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [w.isin(*wanted) for w in found])

    start = this["valence"]
    value = start + F.when(this["caps"] & some_caps, with_sign_of(start, F.lit(CAPITALS))).otherwise(
        F.lit(0.0)
    )
    for distance in (1, 2, 3):
        value = looked_back(value, distance)
    least = (word(1) == "least") & F.get(toks, at - 1)["valence"].isNull()
    value = value * F.when(least & ~word(2).isin(*LEAST_AFTER), NEGATION).otherwise(F.lit(1.0))
    value = value * F.when((but_at > 0) & (at < but_at - 1), BEFORE_BUT).when(
        (but_at > 0) & (at > but_at - 1), AFTER_BUT
    ).otherwise(F.lit(1.0))
    dampens = this["word"].isin(*DAMPING) & (word(-1) == "of")
    silent = this["valence"].isNull() | (modifiers.degree(this) != 0) | dampens
    return F.when(silent, F.lit(0.0)).otherwise(value)


def values(toks: Column, modifiers: Modifiers) -> Column:
    """``array<double>``: the adjusted valence of each rated token."""
    some_caps = F.exists(toks, lambda t: t["caps"]) & F.exists(toks, lambda t: ~t["caps"])
    but_at = F.array_position(F.transform(toks, lambda t: t["word"]), F.lit("but")).cast("int")
    context = F.struct(some_caps.alias("some_caps"), but_at.alias("but_at"))
    return let(
        context,
        lambda c: F.transform(
            toks, lambda t, i: _value(toks, i, c["some_caps"], c["but_at"], modifiers)
        ),
    )


def emphasis(text: Column) -> Column:
    """What exclamation and question marks add to a text's score."""

    def marks(sign: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))

    shouts = F.least(marks("!"), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION
    asks = let(
        marks("?"),
        lambda n: F.when(n <= 1, F.lit(0.0))
        .when(n <= MAX_QUESTIONS, n * QUESTION)
        .otherwise(F.lit(MANY_QUESTIONS)),
    )
    return shouts + asks


def summarize(vals: Column, extra: Column) -> Column:
    """``struct<neg, neu, pos, compound>`` from token values and emphasis."""
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def add(a: Column, v: Column) -> Column:
        return F.struct(
            (a["total"] + v).alias("total"),
            (a["up"] + F.when(v > 0, v + 1.0).otherwise(F.lit(0.0))).alias("up"),
            (a["down"] + F.when(v < 0, v - 1.0).otherwise(F.lit(0.0))).alias("down"),
        )

    def sums(vs: Column) -> Column:
        """Totals over the few words that carry any value, and the count of the rest."""
        return let(
            F.filter(vs, lambda v: v != 0),
            lambda charged: let(
                F.aggregate(charged, zero, add),
                lambda s: F.struct(
                    s["total"].alias("total"),
                    s["up"].alias("up"),
                    s["down"].alias("down"),
                    (F.size(vs) - F.size(charged)).cast("double").alias("flat"),
                ),
            ),
        )

    def scores(s: Column, e: Column) -> Column:
        total = s["total"] + F.signum(s["total"]) * e
        up = s["up"] + F.when(s["up"] > -s["down"], e).otherwise(F.lit(0.0))
        down = -s["down"] + F.when(s["up"] < -s["down"], e).otherwise(F.lit(0.0))
        compound = total / F.sqrt(total * total + ALPHA)
        mass = up + down + s["flat"]

        def part(x: Column) -> Column:
            return F.round(F.coalesce(F.try_divide(x, mass), F.lit(0.0)), 3)

        return F.struct(
            part(down).alias("neg"),
            part(s["flat"]).alias("neu"),
            part(up).alias("pos"),
            F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), compound)), 4).alias("compound"),
        )

    return let(
        vals, lambda vs: let(sums(vs), lambda s: let(extra, lambda e: scores(s, e)))
    )


def polarity(text: Column | str, lexicon: Lexicon | None = None) -> Column:
    """``struct<neg, neu, pos, compound>`` of a text, without shuffle or Python."""
    known = lexicon if lexicon is not None else seed_lexicon()
    return let(
        column(text),
        lambda t: let(
            rate(tokens(t), known),
            lambda toks: summarize(values(toks, Modifiers.from_lexicon(known)), emphasis(t)),
        ),
    )
