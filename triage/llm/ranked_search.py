"""Ranked lexical search: accumulators for short lists, skipping over long ones.

Documents are cut into shards of a bounded number of postings; every shard holds all lists of its
documents and is searched with every item, so lists never cross tasks. In a shard an item's short
lists are read term by term (TAAT): their impacts are summed into one accumulator per document,
and these, in document order with their largest sums per window, become one more iterator. That
iterator and the long lists are then merged document by document (DAAT), a window of consecutive
documents at a time. An item's 20th best score so far is its threshold: a window is skipped where
the iterators' largest values there add up to less, and inside a window only documents of the
accumulators and of those long lists without which the threshold can't be reached are candidates;
the other lists are looked up for candidates only. Thresholds rise from shard to shard of a task.
Scores are whole numbers and bounds are sums of true maxima, so no document is lost.

Statistics (documents with a term, all terms, document frequencies) are counted over all
documents first. Items are read in chunks of bounded size, so that the chunk's words and items
fit a broadcast; each chunk makes its own pass over the documents.

Defined results: null and empty texts have no terms; an item without terms, or none of whose terms
occurs, has no rows; equal scores go by ascending doc_id, null first. Rows are documents: repeated
rows all count and are all ranked. Equal (item_id, text) rows are one item; other texts
under a repeated item_id are items of their own. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triage.llm.tables import Table, map_arrow

TOP = 20
#: Fixed values of the score: scale of weights and impacts, and the constants of the length term.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE, BASE, SLOPE = 1000, 1_000_000_000, 1000, 12, 100, 25
#: Postings to a shard, documents to a window, and bytes of items to a chunk.
SHARD, WINDOW, CHUNK_BYTES = 1_000_000, 512, 8 << 20
#: An item's shortest lists are summed first, as long as they hold so small a share of the shard's documents.
SHORT_SHARE = 0.25

#: A-Z to a-z, and every other byte of ASCII that is no letter or digit to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of other code points, with A-Z lower-cased, in UTF-8."""
    return text.translate(_FOLD).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Item:
    """An item's terms, by place in the chunk's word list, with the weight of all their repeats."""

    terms: np.ndarray
    weights: np.ndarray


class Shard:
    """Lists of (document, impact) by term, with the largest impact of every window."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n: int, total: int):
        self.size = len(lengths)
        self.windows = -(-self.size // WINDOW)
        m = BASE - SLOPE + (SLOPE * lengths * n) // max(total, 1)
        docs = np.repeat(np.arange(self.size), counts)
        order = np.argsort(terms, kind="stable")
        self.docs, tfs = docs[order], tfs[order]
        self.impacts = (IMPACT_SCALE * tfs) // (TF_SCALE * tfs + LENGTH_SCALE * m[self.docs])
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.bounds = np.append(starts, len(order))
        self.place = {t: i for i, t in enumerate(self.terms.tolist())}
        self._maxima: dict[int, np.ndarray] = {}

    def list(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bounds[i], self.bounds[i + 1]
        return self.docs[a:b], self.impacts[a:b]

    def maxima(self, i: int) -> np.ndarray:
        """The largest impact of the list in every window."""
        found = self._maxima.get(i)
        if found is None:
            found = self._maxima[i] = self.window_maxima(*self.list(i))
        return found

    def window_maxima(self, docs: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.windows, dtype=np.int64)
        if len(docs):
            own, starts = np.unique(docs // WINDOW, return_index=True)
            out[own] = np.maximum.reduceat(values, starts)
        return out

    def search(self, item: Item, top: Best) -> None:
        """Offer the shard's documents to an item's best."""
        own = [(self.place[t], w) for t, w in zip(item.terms.tolist(), item.weights.tolist(), strict=True) if t in self.place]
        if not own:
            return
        own.sort(key=lambda x: self.bounds[x[0] + 1] - self.bounds[x[0]])
        lengths = np.array([self.bounds[i + 1] - self.bounds[i] for i, _ in own])
        short = int(np.searchsorted(np.cumsum(lengths), SHORT_SHARE * self.size, side="right"))
        # TAAT: the short lists become one iterator over their documents.
        sums = np.zeros(self.size, dtype=np.int64)
        for i, w in own[:short]:
            docs, impacts = self.list(i)
            sums[docs] += w * impacts
        touched = np.flatnonzero(sums)
        acc_max = self.window_maxima(touched, sums[touched])
        # DAAT: long lists by falling largest value, so that those behind some place can't reach the threshold alone.
        long = [(i, w, w * self.maxima(i)) for i, w in own[short:]]
        long.sort(key=lambda x: -int(x[2].max()))
        bound = acc_max + sum((m for *_, m in long), np.zeros(self.windows, dtype=np.int64))
        reach = np.zeros((len(long) + 1, self.windows), dtype=np.int64)  # what the lists from a place on can add
        for k in range(len(long) - 1, -1, -1):
            reach[k] = reach[k + 1] + long[k][2]
        for x in np.argsort(-bound, kind="stable").tolist():
            if bound[x] < max(top.threshold, 1):
                break  # windows come by falling bound: the rest can't reach it either
            first, last = x * WINDOW, min((x + 1) * WINDOW, self.size)
            window = sums[first:last].copy()
            essential = int((reach[:, x] >= max(top.threshold, 1)).sum())  # lists before it must offer candidates
            marked = window > 0
            for i, w, m in long[:essential]:
                if m[x]:
                    docs, impacts = self.cut(i, first, last)
                    window[docs] += w * impacts
                    marked[docs] = True
            candidates = np.flatnonzero(marked)
            for k in range(essential, len(long)):
                candidates = candidates[window[candidates] + reach[k, x] >= top.threshold]
                if not len(candidates):
                    break
                i, w, m = long[k]
                if m[x]:
                    docs, impacts = self.cut(i, first, last)
                    at = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
                    hit = docs[at] == candidates
                    window[candidates[hit]] += w * impacts[at[hit]]
            top.offer(window[candidates], first + candidates)

    def cut(self, i: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        docs, impacts = self.list(i)
        a, b = np.searchsorted(docs, (first, last))
        return docs[a:b] - first, impacts[a:b]


class Best:
    """The best (score, doc_id) of an item; ``offer`` takes places in the current shard, ``ids`` names them."""

    def __init__(self, most: int):
        self.most, self.threshold = most, 0
        self.scores = np.zeros(0, dtype=np.int64)
        self.found = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)

    def offer(self, scores: np.ndarray, places: np.ndarray) -> None:
        keep = scores >= max(self.threshold, 1)
        if not keep.any():
            return
        self.scores = np.concatenate([self.scores, scores[keep]])
        self.found = np.concatenate([self.found, self.ids[places[keep]]])
        order = np.lexsort((self.found, -self.scores))[: self.most]
        self.scores, self.found = self.scores[order], self.found[order]
        if len(order) == self.most:
            self.threshold = int(self.scores[-1])


#: Stands for a null id in a shard: the first in order.
_NULL = -(1 << 63)


def _chunk_words(items: list) -> tuple[dict[bytes, int], list[Counter]]:
    counted = [Counter(terms((r["text"] or "").encode("utf-8", "surrogatepass"))) for r in items]
    return {t: i for i, t in enumerate(sorted(set().union(*counted)))}, counted


def _index(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms), terms and tfs (of the chunk's words only) of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids, lengths, own, tfs = [], [], [], []
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    found = terms(text.as_py())
                    if not found:
                        continue
                    hits = [(t, c) for w, c in Counter(found).items() if (t := known.get(w)) is not None]
                    ids.append(i)
                    lengths.append(len(found))
                    own.append(np.array([t for t, _ in hits], dtype=np.int32))
                    tfs.append(np.array([c for _, c in hits], dtype=np.int64))
                yield {"doc_id": ids, "n": lengths, "terms": own, "tfs": tfs}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, "doc_id long, n long, terms array<int>, tfs array<long>", count)


def _shards(batches: Iterator[pa.RecordBatch], n: int, total: int) -> Iterator[tuple[np.ndarray, Shard]]:
    """(doc_ids, shard) of as many documents in a row as hold about SHARD postings."""
    parts, held = [], 0

    def build() -> tuple[np.ndarray, Shard]:
        b = pa.Table.from_batches(parts).combine_chunks()
        ids = b.column("doc_id").fill_null(_NULL).to_numpy()
        counts = pc.list_value_length(b.column("terms")).to_numpy()
        flat = [b.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "tfs")]
        return ids, Shard(b.column("n").to_numpy(), counts, *flat, n, total)

    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            parts.append(b)
            held += len(b.column("terms").flatten())
            if held >= SHARD:
                yield build()
                parts, held = [], 0
    if parts:
        yield build()


def search(docs: DataFrame, items: DataFrame, most: int = TOP) -> tuple[DataFrame, list[Table]]:
    """item_id, rank, doc_id, score of every item's ``most`` best documents; tables to drop later."""
    asked = items.select("item_id", "text").filter(F.length("text") > 0).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + size // CHUNK_BYTES
    out, tables = None, []
    for k in range(chunks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k)
        found = Table(_search_chunk(docs, own.collect(), items.schema["item_id"].dataType.simpleString(), most, tables), "ranked")
        tables.append(found)
        out = found.df if out is None else out.unionByName(found.df)
    return out, tables


def _search_chunk(docs: DataFrame, items: list, id_kind: str, most: int, tables: list[Table]) -> DataFrame:
    spark = docs.sparkSession
    words, counted = _chunk_words(items)
    index = Table(_index(docs, words), "postings")
    tables.append(index)
    n, total = index.df.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # As many rows as the chunk has words.
    df = dict(index.df.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect())
    asked = []
    for c in counted:
        own = sorted((words[t], times * weight(n, df[words[t]])) for t, times in c.items() if words[t] in df)
        asked.append(Item(np.array([t for t, _ in own], dtype=np.int64), np.array([w for _, w in own], dtype=np.int64)))
    shared = spark.sparkContext.broadcast((asked, n, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        asked, n, total = shared.value
        best = [Best(most) for _ in asked]
        for ids, shard in _shards(batches, n, total):
            for item, top in zip(asked, best, strict=True):
                top.ids = ids
                shard.search(item, top)
        for i, top in enumerate(best):
            if len(top.scores):
                ids = [None if x == _NULL else x for x in top.found.tolist()]
                yield {"item": [i] * len(ids), "doc_id": ids, "score": top.scores}

    # At most ``most`` rows per item and task.
    partial = map_arrow(index.df, "item int, doc_id long, score long", run)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"item int, item_id {id_kind}")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= most)
        .join(F.broadcast(names), "item")  # the chunk's items
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    )
