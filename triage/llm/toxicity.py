"""Toxic passages as maximal-scoring segments over token log-odds.

Tokens are lower-cased runs of letters; a token unknown as a word is looked up by its first
``STEM`` letters. A token's score is the log-odds of its presence in toxic against clean
training texts under a symmetric Dirichlet prior, less ``CAUTION`` standard deviations, so that a score
rests on how often a token was seen; what stays above ``LEAST`` is kept, any other token costs
``GAP``. A linear scan finds all maximal-scoring
segments of a text. Under clean texts, segments of score S or more number K n exp(-lambda S)
in n tokens; lambda solves the extreme-value equation for the clean score distribution, K is
counted. A text's evidence, the sum of its significant segments in these units less ln(K n),
becomes a score by a logistic curve fitted on texts the token scores were not learned from.

Defined results: null and empty texts have no segments and get the score of no evidence;
equal texts get equal scores; a label that is null is no label, of several labels for one id the
largest counts; without labels of both classes every score is 0. Extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm.tables import Table, id_remainder, map_lists, share_of_ids

WORD = re.compile(r"[^\W\d_]+")
STEM = 4
GAP = 0.1
CAUTION = 1.64
LEAST = 1.5
CLIP = 40.0


def tokens_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def smallest_hash(tokens: list[str]) -> int:
    """The smallest hash of three neighbouring tokens; copies share it, near copies mostly."""
    runs = {" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))}
    return min(xxhash.xxh64_intdigest(r) for r in runs) >> 1


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (start, end, score), end not included, in order.

    Ruzzo and Tompa's scan over the runs of equal sign, so that long stretches without a
    positive token count as one step.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(scores)]])
    sums = np.add.reduceat(scores, starts)
    found: list[list] = []  # start, end, sum before it, sum up to its end
    total = 0.0
    for a, b, s in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if s <= 0:
            total += s
            continue
        new = [a, b, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(repr=False)
    rate: float = 1.0  # lambda
    density: float = 1.0  # K
    offset: float = -20.0
    slope: float = 0.0
    fitted: bool = False

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        get = self.scores.get
        found = [get(t) or get(t[:STEM] + "*", -GAP) for t in tokens]
        return np.asarray(found, dtype=np.float64)

    def significant(self, tokens: list[str]) -> list[tuple[int, int, float, float]]:
        """(start, end, score, expected number by chance) of segments expected less than once."""
        n = max(len(tokens), 1)
        out = []
        for a, b, s in segments(self.token_scores(tokens)):
            chance = self.density * n * math.exp(-self.rate * min(s, 500.0))
            if chance < 1.0:
                out.append((a, b, s, chance))
        return out

    def evidence(self, tokens: list[str]) -> float:
        total = sum(s for _, _, s, _ in self.significant(tokens))
        x = self.rate * total - math.log(max(self.density * max(len(tokens), 1), 1e-12))
        return max(-CLIP, min(CLIP, x)) if total > 0 else -CLIP

    def score(self, x: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.offset + self.slope * x)))) if self.fitted else 0.0


def training_labels(labels: DataFrame, max_fit_docs: int, seed: str = "toxic") -> tuple[DataFrame, dict[int, float]]:
    """At most about ``max_fit_docs`` labelled ids of each class outside the held-out part; their shares."""
    own = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", id_remainder("doc_id", 5))
        .filter("fold <> 0")
    )
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {y: min(1.0, max_fit_docs / n) for y, n in sizes.items()}
    chosen = F.lit(False)
    for y, share in shares.items():
        chosen |= (F.col("toxic") == y) & (share_of_ids("doc_id", seed) < share)
    return own.filter(chosen), shares


def fit(docs: DataFrame, labels: DataFrame, max_fit_docs: int = 10_000, prior: float = 0.5) -> ToxicityModel:
    """Token scores from folds 1 to 3 of the ids' crc32, calibration from fold 4.

    ``max_fit_docs`` bounds the labelled rows of each class used to fit (their ids, at most
    some 2 x ``max_fit_docs``, are what is broadcast). ``prior`` is added to every count. Copies
    and most near copies (equal smallest hash of three words) count once per class, since a
    group of them would make all its words look telling: the row with the smallest hashed id, then
    text, stands for them. The fit does not hang on the order of rows.
    """
    chosen, shares = training_labels(labels, max_fit_docs)

    def mark(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {**b, "h": [smallest_hash(tokens_of(t)) for t in b["text"]]}

    labelled = docs.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    place = F.xxhash64(F.lit("toxic"), "doc_id").alias("place")
    marked = map_lists(
        labelled.select(place, "text", "toxic", "fold"), "place long, text string, toxic int, fold long, h long", mark
    )
    first = F.min(F.struct("place", "text", "fold")).alias("first")
    written = Table(marked.groupBy("h", "toxic").agg(first).select("toxic", "first.text", "first.fold"), "toxic-sample")
    sample = written.df

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(b["text"], b["toxic"], strict=True):
                words = set(tokens_of(text))
                seen[y].update(words)
                seen[y].update({w[:STEM] + "*" for w in words if len(w) >= STEM})
            keys = list(seen[0].keys() | seen[1].keys())
            yield {"token": keys, "clean": [seen[0][k] for k in keys], "tox": [seen[1][k] for k in keys]}

    counts = (
        map_lists(sample.filter("fold <> 4").select("text", "toxic"), "token string, clean long, tox long", count)
        .groupBy("token")
        .agg(F.sum("clean").alias("clean"), F.sum("tox").alias("tox"))
        .withColumn("kind", F.col("token").endswith("*"))
        .persist()
    )
    kept: dict[str, float] = {}
    sums = counts.groupBy("kind").agg(F.sum("clean").alias("c"), F.sum("tox").alias("t"), F.count("*").alias("n")).collect()
    for r in sums:
        c, t = float(r["c"]), float(r["t"])
        if not c or not t:
            continue
        size = F.lit(prior * r["n"])
        yt, yc = F.col("tox") + prior, F.col("clean") + prior
        odds = F.log(yt / (t + size - yt)) - F.log(yc / (c + size - yc))
        rows = (
            counts.filter(F.col("kind") == r["kind"])
            .select("token", odds.alias("odds"), F.sqrt(1 / yt + 1 / yc).alias("sd"))
            .filter(F.col("odds") - CAUTION * F.col("sd") >= LEAST)
        )
        kept |= {x["token"]: x["odds"] - CAUTION * x["sd"] for x in rows.collect()}
    counts.unpersist()
    model = ToxicityModel(kept)
    if kept and not _calibrate(sample.filter("fold = 4"), model, shares):
        _calibrate(sample, model, shares)
    written.drop()
    return model


def _calibrate(sample: DataFrame, model: ToxicityModel, shares: dict[int, float]) -> bool:
    """lambda, K and the logistic curve, rows weighted by the share their class was drawn at.

    False, and no curve, if a class is missing.
    """
    bare, floor = ToxicityModel(model.scores), min(model.scores.values())

    def measure(batches: Iterator[dict]) -> Iterator[dict]:
        """Of clean texts the tokens, the segments of at least the smallest score, and how often each score occurs."""
        for b in batches:
            seen: Counter = Counter()
            for text, y in zip(b["text"], b["toxic"], strict=True):
                seen[f"class {y}", 0.0] += 1
                if y == 0:
                    scores = bare.token_scores(tokens_of(text))
                    seen["tokens", 0.0] += len(scores)
                    seen["segments", 0.0] += sum(x[2] >= floor for x in segments(scores))
                    seen.update(("hit", x) for x in scores[scores > 0].tolist())
            yield {"what": [k for k, _ in seen], "score": [x for _, x in seen], "n": list(seen.values())}

    # A row for each different score at most.
    rows = map_lists(sample.select("text", "toxic"), "what string, score double, n long", measure)
    found = rows.groupBy("what", "score").agg(F.sum("n").alias("n")).orderBy("what", "score").collect()
    total = {r["what"]: r["n"] for r in found if r["what"] != "hit"}
    if not total.get("class 0") or not total.get("class 1"):
        return False
    n = total["tokens"] + 1
    # One more positive token of the smallest score than was seen, so that the equation has a root.
    hits = np.asarray([r["score"] for r in found if r["what"] == "hit"] + [floor])
    times = np.asarray([r["n"] for r in found if r["what"] == "hit"] + [1])
    miss = max(n - times.sum(), 1)
    low, high = 0.0, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        value = (miss * math.exp(-GAP * mid) + (times * np.exp(np.minimum(hits * mid, 700))).sum()) / (miss + times.sum())
        low, high = (mid, high) if value < 1 else (low, mid)
    model.rate = max(low, 0.05)
    model.density = (total["segments"] + 1) / (n * math.exp(-model.rate * floor))
    known = ToxicityModel(model.scores, model.rate, model.density)

    def weigh(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"toxic": b["toxic"], "x": [known.evidence(tokens_of(t)) for t in b["text"]]}

    # Two numbers for each text of the sample, whose size ``max_fit_docs`` bounds.
    points = sorted((r["x"], r["toxic"]) for r in map_lists(sample.select("text", "toxic"), "toxic int, x double", weigh).collect())
    x, y = zip(*points, strict=True)
    xs, ys, w = np.column_stack([np.ones(len(x)), np.asarray(x)]), np.asarray(y, dtype=float), np.zeros(2)
    each = np.asarray([1 / shares[v] for v in y])
    for _ in range(100):  # Newton steps with a small ridge, which also holds separable classes
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -500, 500)))
        slope = xs.T @ (each * (p - ys)) + 1e-3 * w
        step = np.linalg.solve((xs * (each * p * (1 - p))[:, None]).T @ xs + 1e-3 * np.eye(2), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.offset, model.slope, model.fitted = float(w[0]), float(w[1]), True
    return True


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, and all significant passages with their token places, score and chance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, passages array<struct<start:int,end:int,score:double,chance:double>>"

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        for b in batches:
            lists = [tokens_of(t) for t in b["text"]]
            yield {
                "doc_id": b["doc_id"],
                "score": [m.score(m.evidence(x)) for x in lists],
                "passages": [
                    [{"start": p, "end": q, "score": s, "chance": e} for p, q, s, e in m.significant(x)] for x in lists
                ],
            }

    return map_lists(docs.select(F.col("doc_id").cast("long"), "text"), schema, run)
