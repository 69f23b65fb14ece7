"""Keyword rules from a table of any size, found by a rare piece of each keyword.

A keyword's anchor is its rarest run of four code points in the rule book; a shorter keyword is its
own anchor. A text that holds a keyword holds its anchor, so only keywords whose anchor is one
of the text's runs need be searched for. What a text costs goes by its length, not by the number of rules.

Up to ``IN_ROW_BYTES`` of keywords the index is a constant array of buckets by the anchor's hash,
made once on the driver: every run of a text is looked up by its place in that array, so labels
stay a projection, without a join or shuffle, on streams too. Only keywords whose anchor's whole hash
is found are asked for, in the order of their ranks until the first that is in the text. Larger rule books stay tables:
different texts are unfolded to the hashes of their runs, joined with the anchors, and the
keywords found in this way verified on the text. Both give the same labels as trying all keywords.

Defined results: the category of the lowest rule number among a text's keywords decides, where
categories rank by the lowest rule number each has in the book, as in ``rules_from_frame``; rules
with a null pattern or category count for nothing; an empty pattern is in every text; a null text has
no category. Matching is by code points, case-sensitive.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.functions.binding import let
from triage.operators.columns import require_columns
from triage.sources.folders import write_through

ANCHOR = 4
#: Rule books up to so many bytes of patterns are looked up in the row.
IN_ROW_BYTES = 4 << 20
#: Bytes of a code point in the text's fixed-width form, whose slices are found at once.
WIDTH = 4


def _wide(c: Column) -> Column:
    return F.encode(c, "UTF-32")


def _starts(wide: Column, length: int) -> Column:
    """Where runs of ``length`` code points start; nowhere in a shorter text."""
    last = F.octet_length(wide) - WIDTH * length + 1
    found = F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(WIDTH))
    return F.when(last >= 1, found).otherwise(F.array().cast("array<int>"))


def _runs(wide: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` code points."""
    return F.transform(_starts(wide, length), lambda at: F.xxhash64(F.substr(wide, at, F.lit(WIDTH * length))))


def ranked(rules: DataFrame) -> DataFrame:
    """(rank, category, pattern) of every different rule; rank orders categories by their lowest rule number."""
    require_columns(rules, ("rule_no", "category", "pattern"))
    own = rules.where(F.col("category").isNotNull() & F.col("pattern").isNotNull())
    return (
        own.join(own.groupBy("category").agg(F.min("rule_no").alias("rank")), "category")
        .select("rank", "category", "pattern")
        .distinct()
    )


def anchored(rules: DataFrame) -> DataFrame:
    """(anchor, length, rank, category, pattern): each pattern with the hash of its rarest run."""
    length = F.least(F.char_length("pattern"), F.lit(ANCHOR))
    own = rules.where(F.length("pattern") > 0).withColumn("length", length)
    runs = own.withColumn("_wide", _wide(F.col("pattern")))
    cases = F.coalesce(*(F.when(F.col("length") == n, _runs(F.col("_wide"), n)) for n in range(1, ANCHOR + 1)))
    runs = runs.select("length", "rank", "category", "pattern", F.explode(F.array_distinct(cases)).alias("run"))
    common = runs.groupBy("length", "run").agg(F.count("*").alias("shared"))
    rarest = F.min(F.struct("shared", "run"))["run"].alias("anchor")
    return runs.join(common, ["length", "run"]).groupBy("length", "rank", "category", "pattern").agg(rarest)


@dataclass(frozen=True)
class KeywordIndex:
    """A rule book ready to be looked up."""

    rules: DataFrame  # anchored
    always: tuple[int, str] | None  # rank and category of the empty pattern
    lengths: Sequence[int]
    n_bytes: int
    buckets: str | None = None  # JSON, for books looked up in the row: anchors and the numbers of their keywords
    n_buckets: int = 0
    entries: str = "[]"  # JSON of categories and keywords by their number, in the order of ranks
    empty: Sequence[int] = ()  # numbers of the empty pattern

    @property
    def in_row(self) -> bool:
        return self.buckets is not None

    def category(self, text: Column) -> Column:
        """The category of a text, as a projection; only of a book that is looked up in the row."""
        if not self.in_row:
            raise ValueError("the rule book is too large for a projection: use with_category")
        slots = F.from_json(F.lit(self.buckets), "array<struct<a:bigint,i:array<int>,more:array<struct<a:bigint,i:array<int>>>>>")
        book = F.from_json(F.lit(self.entries), "array<struct<c:string,p:string>>")

        def slot(known: Column, run: Column) -> Column:
            return F.get(known["slots"], F.pmod(run, F.lit(self.n_buckets)).cast("int"))

        def asked(wide: Column, known: Column) -> Column:
            """Numbers of the keywords whose anchor is a run of the text; equal runs are looked up once."""

            def of_run(run: Column) -> Column:
                here = slot(known, run)
                rest = F.flatten(F.transform(F.filter(here["more"], lambda e: e["a"] == run), lambda e: e["i"]))
                return F.when(here["a"] == run, here["i"]).otherwise(F.coalesce(rest, F.array().cast("array<int>")))

            runs = [F.array_distinct(_runs(wide, n)) for n in self.lengths]
            places = F.concat(*(F.filter(r, lambda run: slot(known, run).isNotNull()) for r in runs))
            always = F.array(*map(F.lit, self.empty)).cast("array<int>")
            return F.concat(F.flatten(F.transform(places, of_run)), always) if runs else always

        def best(numbers: Column, known: Column) -> Column:
            # The book is in the order of ranks: the first keyword that is in the text decides, later ones are not searched for.
            def later(number: Column) -> Column:
                return F.when(F.contains(text, F.get(known["book"], number)["p"]), number)

            first = F.aggregate(
                F.sort_array(F.array_distinct(numbers)), F.lit(None).cast("int"), lambda a, i: F.coalesce(a, later(i))
            )
            return F.get(known["book"], first)["c"]

        def look_up(known: Column) -> Column:
            return let(let(_wide(text), lambda w: asked(w, known)), lambda numbers: best(numbers, known))

        known = F.struct(slots.alias("slots"), book.alias("book"))
        return F.when(text.isNotNull(), let(known, look_up))

    def _constant(self) -> Column:
        if self.always is None:
            return F.array().cast("array<struct<r:bigint,c:string>>")
        rank, category = self.always
        return F.array(F.struct(F.lit(rank).cast("bigint").alias("r"), F.lit(category).alias("c")))

    def with_category(self, df: DataFrame, text: str, name: str = "category") -> DataFrame:
        """``df`` with the category of its text in a column ``name``."""
        if self.in_row:
            return df.withColumn(name, self.category(F.col(text)))
        # One row for each different text; its two hashes stand for it on the way to the anchors.
        key = [F.xxhash64(F.col(text)).alias("_k1"), F.hash(F.col(text)).alias("_k2")]
        texts = write_through(df.select(*key, F.col(text).alias("_text")).where("_text is not null").dropDuplicates(["_k1", "_k2"]), "rule-texts")
        own = F.concat(*(_tagged(n) for n in self.lengths))
        runs = texts.withColumn("_wide", _wide(F.col("_text"))).select("_k1", "_k2", F.explode(F.array_distinct(own)).alias("_run"))
        asked = runs.join(self.rules, (F.col("_run.run") == F.col("anchor")) & (F.col("_run.length") == F.col("length")))
        asked = asked.select("_k1", "_k2", "rank", "category", "pattern").distinct()
        found = (
            asked.join(texts, ["_k1", "_k2"])
            .where(F.contains("_text", F.col("pattern")))
            .groupBy("_k1", "_k2")
            .agg(F.min(F.struct(F.col("rank").alias("r"), F.col("category").alias("c"))).alias("_found"))
        )
        joined = df.withColumns({"_k1": key[0], "_k2": key[1]}).join(found, ["_k1", "_k2"], "left")
        best = F.array_min(F.concat(F.filter(F.array("_found"), lambda x: x.isNotNull()), self._constant()))["c"]
        return joined.select(*[c for c in df.columns if c != name], F.when(F.col(text).isNotNull(), best).alias(name))


def _tagged(n: int) -> Column:
    return F.transform(_runs(F.col("_wide"), n), lambda h: F.struct(h.alias("run"), F.lit(n).alias("length")))


def keyword_index(rules: DataFrame, in_row_bytes: int = IN_ROW_BYTES) -> KeywordIndex:
    """The index of a table ``(rule_no, category, pattern)``; written to the work folder."""
    book = write_through(ranked(rules), "rules")
    size = book.agg(F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length("category")), F.lit(0))).first()[0]
    first = book.where("pattern = ''").orderBy("rank").first()
    always = (first["rank"], first["category"]) if first else None
    table = write_through(anchored(book), "anchors")
    lengths = sorted(r["length"] for r in table.select("length").distinct().collect())  # at most four
    index = KeywordIndex(table, always, lengths, size)
    if size > in_row_bytes:
        return index
    rows = table.select("anchor", "rank", "category", "pattern").collect()  # bounded by in_row_bytes
    # Sorted by rank, category and keyword, so that the lowest number found names the category.
    keywords = sorted([(r["rank"], r["category"], r["pattern"], r["anchor"]) for r in rows] + ([(*always, "", None)] if always else []))
    n = 1 << max(4, (4 * len(rows)).bit_length())
    by_anchor: dict[int, list[int]] = {}
    for number, (_, _, _, anchor) in enumerate(keywords):
        if anchor is not None:
            by_anchor.setdefault(anchor, []).append(number)
    buckets: list[dict | None] = [None] * n
    for anchor, numbers in by_anchor.items():  # most buckets hold one anchor
        first, own = buckets[anchor % n], {"a": anchor, "i": numbers}
        if first is None:
            buckets[anchor % n] = own
        else:
            first.setdefault("more", []).append(own)
    entries = [{"c": c, "p": p} for _, c, p, _ in keywords]
    empty = [number for number, k in enumerate(keywords) if not k[2]]
    index = replace(index, buckets=json.dumps(buckets, separators=(",", ":")), n_buckets=n)
    return replace(index, entries=json.dumps(entries, ensure_ascii=False), empty=empty)
