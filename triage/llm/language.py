"""Language identification by known words first, then ever shorter character n-grams.

A word is a letter and the letters and marks behind it, lower-cased. One seen in training is
scored by its log frequency in each language. For any other word the n-grams of the word between
its boundary marks are looked up, five characters long first; the longest length with a known
n-gram gives the mean of their log frequencies. A text's language is the one with the largest
sum over all its words. Words and n-grams are known by their 64-bit hashes, sorted, beside one
matrix of scores, so that a worker holds a few bytes for each.

Defined results: a null text or one without a letter is ``und`` with score 0; a text none of
whose characters was seen gets the most frequent language with an even score; equal sums go to
the language first in the alphabet; without any training row all texts are ``und``. Repeated
rows are scored each. Extra columns are left out of the result of ``predict``; ``confident``
keeps all columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.tables import id_text, map_lists, ship, slices

ASCII_WORD, WORD = re.compile("[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST = 5
UNKNOWN = "und"
#: Words are unfolded to n-grams in slices of so many bytes.
UNFOLD_BYTES = 1 << 20


def words_of(text: str | None) -> list[str]:
    own = text.lower() if text else ""
    return ASCII_WORD.findall(own) if own.isascii() else WORD.findall(own)


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def hashes(items: list[str], kind: int) -> np.ndarray:
    """A long for every item of a kind: 0 for words, else the length of n-grams."""
    digest, mark = xxhash.xxh64_intdigest, str(kind)
    return np.array([digest(f"{mark}{x}".encode()) for x in items], dtype=np.uint64).view(np.int64)


@dataclass
class LanguageModel:
    """Log frequencies by language (in the order of ``languages``) of words and n-grams."""

    languages: list[str]
    rows: list[float]
    keys: np.ndarray = field(repr=False)  # ascending
    scores: np.ndarray = field(repr=False)  # key x language

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, -1 if it is unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for every word."""
        k = len(self.languages)
        out = np.zeros((len(words), k))
        at = self.find(hashes(words, 0))
        out[at >= 0] = self.scores[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            own = [grams(words[i], n) for i in left.tolist()]
            at = self.find(hashes(list(chain.from_iterable(own)), n))
            word = np.repeat(np.arange(len(left)), [len(g) for g in own])[at >= 0]
            found = np.bincount(word, minlength=len(left))
            known = self.scores[at[at >= 0]]
            for j in range(k):
                sums = np.bincount(word, weights=known[:, j], minlength=len(left))
                out[left, j] = sums / np.maximum(found, 1)
            left = left[found == 0]
        return out


def share_of_rows(seed: str) -> Column:
    """A number in [0, 1) that depends on a row's id and text alone."""
    return F.pmod(F.xxhash64(F.lit(seed), id_text("doc_id"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fit(
    docs: DataFrame, max_docs_per_language: int = 4000, min_count: int = 3, seed: str = "language"
) -> LanguageModel:
    """A model from ``text`` and ``lang``.

    ``max_docs_per_language`` bounds the labelled rows used: of a language with more, the rows
    whose hashed id and text fall below the fitting share are taken, with their whole texts. Words and
    n-grams seen fewer than ``min_count`` times are left to the back-off.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], [], np.zeros(0, dtype=np.int64), np.zeros((0, 0)))
    chosen = F.lit(False)
    for lang in languages:
        share = min(1.0, max_docs_per_language / sizes[lang])
        chosen |= (F.col("lang") == lang) & (share_of_rows(seed) < share)

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            seen: Counter = Counter()
            for text, lang in zip(b["text"], b["lang"], strict=True):
                seen.update((lang, w) for w in words_of(text))
            keys = list(seen)
            yield {"lang": [k[0] for k in keys], "word": [k[1] for k in keys], "n": [seen[k] for k in keys]}

    def unfold(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for kind in range(LONGEST + 1):
                seen: Counter = Counter()
                for lang, word, times in zip(b["lang"], b["word"], b["n"], strict=True):
                    for g in grams(word, kind) if kind else (word,):
                        seen[lang, g] += times
                langs, items = zip(*seen, strict=True) if seen else ((), ())
                yield {"lang": langs, "kind": [kind] * len(items), "key": hashes(items, kind), "n": list(seen.values())}

    words = (
        map_lists(labelled.filter(chosen).select("text", "lang"), "lang string, word string, n long", count)
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    items = (
        map_lists(words, "lang string, kind int, key long, n long", unfold, UNFOLD_BYTES)
        .groupBy("kind", "key")
        .agg(
            F.sum("n").alias("n"),
            *(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(languages)),
        )
        .filter(F.col("n") >= min_count)
        .drop("n")
        .toArrow()
    )
    kinds, keys, *own = (c.to_numpy() for c in items.columns)
    order = np.argsort(keys)
    kinds, keys = kinds[order], keys[order]
    counts = np.stack(own, axis=1).astype(np.float64)[order]
    learned = counts.sum(0) > 0  # a language all of whose texts are empty would get an even share
    counts = counts[:, learned]
    scores = np.zeros(counts.shape, dtype=np.float32)
    for kind in np.unique(kinds):
        own = kinds == kind
        total = counts[own].sum(0)
        # What a language has not shown is as unlikely in each, however little of it was read.
        extra = 0.1 * np.maximum(total, 1e-9) / max(total.max(), 1e-9)
        scores[own] = np.log((counts[own] + extra) / (total + extra * own.sum() + 1e-12))
    kept = [x for x, own in zip(languages, learned, strict=True) if own]
    return LanguageModel(kept, [float(sizes[x]) for x in kept], keys, scores)


#: Scores of so many different words are kept in a task before it starts anew.
REMEMBERED = 100_000


class Judge:
    """Languages and scores of texts; remembers the scores of words."""

    def __init__(self, model: LanguageModel):
        self.model, self.places = model, {}
        self.table = np.zeros((1024, max(len(model.languages), 1)))

    def _learn(self, texts: list[list[str]]) -> None:
        places = self.places
        if len(places) > REMEMBERED:
            places.clear()
        fresh = list(set().union(*texts).difference(places))
        if not fresh:
            return
        first = len(places)
        while first + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(fresh)] = self.model.word_scores(fresh)
        places.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        m = self.model
        k = len(m.languages)
        split = [words_of(t) for t in texts] if k else [[] for _ in texts]
        self._learn(split)
        out, shares = [], []
        for words in split:
            if not words:
                out.append(UNKNOWN)
                shares.append(0.0)
                continue
            total = self.table[list(map(self.places.__getitem__, words))].sum(0)
            if not total.any():
                out.append(m.languages[int(np.argmax(m.rows))])
                shares.append(1.0 / k)
                continue
            best = int(np.argmax(total))
            soft = np.exp((total - total[best]) / np.sqrt(len(words)))
            out.append(m.languages[best])
            shares.append(float(1.0 / soft.sum()))
        return out, shares


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (share of the best language, softened by the text's length)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[dict]) -> Iterator[dict]:
        judge = Judge(shared.value)
        for b in batches:
            found, shares = judge.judge(b["text"])
            yield {"doc_id": b["doc_id"], "lang_pred": found, "score": shares}

    return map_lists(
        docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, lang_pred string, score double", score
    )


def confident(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, that have a language with a score of at least ``least``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for b in batches:
            for part in slices(b):
                found, shares = judge.judge(part.column("text").to_pylist())
                good = [x != UNKNOWN and s >= least for x, s in zip(found, shares, strict=True)]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
