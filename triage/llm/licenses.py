"""License scan: phrases by place, and templates by an exact containment join.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A text block
is a line. A block holds a template if at least ``threshold`` of the template's distinct words
are among the block's. Words are ordered by how many blocks of the whole corpus hold them,
rarest first. If a block reaches the threshold, it has one of the template's first
m - ceil(threshold m) + 1 words (prefix filter), at least ceil(threshold m) words (length
filter), and after a shared prefix word enough words left on both sides (positional filter);
candidates that pass are counted in full, so the join is exact.

A notice wrapped over several lines is found in windows of words that cross line ends, as long as
the template's words over the threshold; the prefix and length filters are put to the whole text.
Where a line holds as much of the template by itself, its windows are not given again.

Defined results: null and empty texts have no words, no places and empty labels; a block that
meets several templates gets them all; repeated rows are scanned each. Extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm.tables import map_lists

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices as they stand in files, by label (publicly known wording).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at"
    ),
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify "
        "it under the terms of the GNU General Public License"
    ),
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.translate(UPPER)) if text else []


def places(words: list[str], phrase: list[str]) -> list[int]:
    """All starts at which the phrase's words stand consecutively; they may overlap."""
    out, k, at = [], len(phrase), -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + k] == phrase:
            out.append(at)


class TemplateIndex:
    """Templates with their words in corpus order, and the lists of their prefix words."""

    def __init__(self, templates: Mapping[str, str], frequency: Mapping[str, int], threshold: float):
        self.rank = {
            w: i
            for i, w in enumerate(
                sorted({w for t in templates.values() for w in words_of(t)}, key=lambda w: (frequency.get(w, 0), w))
            )
        }
        self.templates = {}
        self.prefixes: dict[str, list[tuple[str, int]]] = {}
        for label, text in templates.items():
            ordered = sorted(set(words_of(text)), key=self.rank.__getitem__)
            if not ordered:
                continue
            need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
            self.templates[label] = (frozenset(ordered), need)
            for p, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefixes.setdefault(w, []).append((label, p))
        self.keys = frozenset(self.prefixes)
        self.room = {x: math.ceil(len(words_of(templates[x])) / threshold - 1e-9) for x in self.templates}

    def matches(self, block: set[str]) -> dict[str, float]:
        """Containment of every template that reaches the threshold in the block's words."""
        hits = self.keys & block
        if not hits:
            return {}
        # Only words of templates can overlap, so they alone need a place in the order.
        known = sorted((w for w in block if w in self.rank), key=self.rank.__getitem__)
        out: dict[str, float] = {}
        done = set()
        for q, w in enumerate(known):
            for label, p in self.prefixes.get(w, ()):
                if label in done:
                    continue
                done.add(label)  # the first shared word in the order decides
                words, need = self.templates[label]
                if len(block) < need or 1 + min(len(words) - p - 1, len(known) - q - 1) < need:
                    continue
                shared = len(words & block)
                if shared >= need:
                    out[label] = shared / len(words)
        return out


    def wrapped(self, words: list[str], lines: list[int], whole: Mapping[tuple[int, str], float]) -> list[dict]:
        """Templates in windows over several lines; ``lines`` has each word's line, ``whole`` what (line, label) holds alone."""
        present = set(words)
        out = []
        for label in sorted({x for w in self.keys & present for x, _ in self.prefixes[w]}):
            own, need = self.templates[label]
            if len(own & present) < need:
                continue
            at = [i for i, w in enumerate(words) if w in own]
            seen: Counter = Counter()
            first, best, end = 0, None, -1
            for i in at:
                seen[words[i]] += 1
                # Leave what is out of the window, and words at its start that stand in it again.
                while i - at[first] >= self.room[label] or seen[words[at[first]]] > 1:
                    seen[words[at[first]]] -= 1
                    if not seen[words[at[first]]]:
                        del seen[words[at[first]]]
                    first += 1
                a, b, share = lines[at[first]], lines[i], len(seen) / len(own)
                if len(seen) < need or a == b or any(whole.get((n, label), 0.0) >= share for n in range(a, b + 1)):
                    continue
                if at[first] > end:  # of windows that overlap the best one counts
                    best = {"line": a, "last_line": b, "label": label, "containment": share}
                    out.append(best)
                elif share > best["containment"]:
                    best.update(line=a, last_line=b, containment=share)
                end = i
        return out


def word_frequencies(docs: DataFrame, templates: Mapping[str, str]) -> dict[str, int]:
    """In how many lines of the corpus each word of the templates stands (a bounded table)."""
    wanted = frozenset(w for t in templates.values() for w in words_of(t))

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                for line in text.translate(UPPER).split("\n"):
                    seen.update(wanted.intersection(WORDS.findall(line)))
        yield {"word": list(seen), "n": list(seen.values())}

    rows = map_lists(docs.filter("text is not null").select("text"), "word string, n long", count)
    return {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per document: word and phrase counts, and every line that holds a template.

    ``hits`` lists (line, label, containment); ``score`` is 1 where a phrase stands, else the
    best containment of a hit, else 0. ``wrapped`` lists (line, last_line, label, containment) of
    templates that go over several lines.
    """
    index = docs.sparkSession.sparkContext.broadcast(
        (TemplateIndex(templates, word_frequencies(docs, templates), threshold), [(words_of(p), x) for p, x in phrases.items()])
    )
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "hits array<struct<line:int,label:string,containment:double>>, score double, "
        "wrapped array<struct<line:int,last_line:int,label:string,containment:double>>"
    )

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        found, wanted = index.value
        first = frozenset(p[0] for p, _ in wanted if p)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "hits", "score", "wrapped")}
            for text in b["text"]:
                starts, labels, hits, total = [], set(), [], 0
                words: list[str] = []
                lines: list[int] = []
                for number, line in enumerate((text or "").translate(UPPER).split("\n")):
                    own = WORDS.findall(line)
                    words += own
                    lines += [number] * len(own)
                    block = set(own)
                    if not found.keys.isdisjoint(block):
                        hits += [{"line": number, "label": x, "containment": c} for x, c in sorted(found.matches(block).items())]
                if not first.isdisjoint(words):
                    for phrase, label in wanted:
                        if phrase and (at := places(words, phrase)):
                            starts += at
                            labels.add(label)
                total = len(words)
                out["n_words"].append(total)
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(sorted(labels))
                out["hits"].append(hits)
                out["wrapped"].append(found.wrapped(words, lines, {(h["line"], h["label"]): h["containment"] for h in hits}))
                out["score"].append(1.0 if starts else max((h["containment"] for h in hits), default=0.0))
            yield {"doc_id": b["doc_id"], **out}

    return map_lists(docs.select(F.col("doc_id").cast("long"), "text"), schema, run)
