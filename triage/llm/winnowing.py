"""Winnowing fingerprints with DataFrame functions only.

A text is lower-cased and cut into its code points, so that texts of every length and script are
compared alike. Every run of k code points is hashed, and of every w consecutive hashes the
smallest is kept, the rightmost of equal ones, with its position. Any common run of w + k - 1
code points of two texts is therefore found in both fingerprints. A hash (37 bits) and the complement
of its position (26 bits) stand in one long, so that the least long of a window is the rightmost
smallest hash.

The text is written in four bytes for each code point, so that a run is a slice of it, shorter
than one block of the hash function. Runs are hashed afresh instead of rolled: a rolling sum takes
a state along the text, and array functions keep one only in ``aggregate``, which copies its array
at every step.

An edited text keeps the prints of what was left alone; windows are worked out again only from
the first one that touches the edit. Where lower-casing depends on the context (capital sigma) or
changes the length, the whole edited text is winnowed.

Defined results: a null text counts as empty; an empty text has an empty fingerprint;
with fewer than k code points all of them are one run, with fewer than w runs all are one window.
Two empty fingerprints are alike (1), an empty and another are not (0). Repeated rows get equal
results. Positions are exact below 67 million code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triage.functions.binding import let

K, W = 6, 4
BITS = 26
LAST = (1 << BITS) - 1
HASH = ((1 << 37) - 1) << BITS
SIGMA = "\u03a3"


def _windows(v: Column, w: int) -> Column:
    """The least values of every w consecutive ones, each once; they hold their place, so equal ones are neighbours."""

    def least(x: Column) -> Column:
        every = F.transform(x, lambda a, i: F.least(a, *(F.get(x, i + j) for j in range(1, w)))) if w > 1 else x
        return F.slice(every, 1, F.size(x) - (w - 1))

    return let(let(v, least), lambda m: F.filter(m, lambda a, i: ~a.eqNullSafe(F.get(m, i - 1))))


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The kept (hash, position) pairs as packed longs, in order of position."""

    def pack(run: Column, i: Column) -> Column:
        return F.xxhash64(run).bitwiseAND(F.lit(HASH)).bitwiseOR((F.lit(LAST) - i).cast("long"))

    def runs(b: Column) -> Column:
        size = F.octet_length(b)
        many = F.transform(F.sequence(F.lit(1), size - 4 * k + 1, F.lit(4)), lambda at, i: pack(F.substr(b, at, F.lit(4 * k)), i))
        return F.when(size >= 4 * k, many).otherwise(F.array(pack(b, F.lit(0))))

    def least(v: Column) -> Column:
        return F.when(F.size(v) > w, _windows(v, w)).otherwise(F.array(F.array_min(v)))

    found = let(F.encode(F.lower(text), "UTF-32"), lambda b: let(runs(b), least))
    return F.when(F.length(text) > 0, found).otherwise(F.array().cast("array<bigint>"))


def winnow_edited(kept: Column, text: Column, edited: Column, same: Column, k: int = K, w: int = W) -> Column:
    """The prints of ``edited``, whose first ``same`` code points are those of ``text`` with prints ``kept``."""
    # Windows before `first` lie in the common part; a print is one of the edit's from there on.
    first = F.greatest(F.lit(0), same - (w + k - 2)).cast("int")
    again = F.greatest(F.lit(0), first - (w - 1))
    plain = ~F.contains(edited, F.lit(SIGMA)) & ~F.contains(text, F.lit(SIGMA)) & (F.length(F.lower(text)) == F.length(text))

    def joined(p: Column, q: Column) -> Column:
        tail = winnow(F.substr(edited, q + 1, F.greatest(F.length(edited) - q, F.lit(0))), k, w)
        moved = F.transform(tail, lambda x: x - q)
        return F.concat(F.filter(kept, lambda x: position(x) < p), F.filter(moved, lambda x: position(x) >= p))

    return F.when(plain & (first > 0), let(first, lambda p: let(again, lambda q: joined(p, q)))).otherwise(winnow(edited, k, w))


def position(packed: Column) -> Column:
    return F.lit(LAST) - packed.bitwiseAND(F.lit(LAST))


def hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, BITS)))


def positions(packed: Column) -> Column:
    """(hash, position) pairs, for matches between two texts."""
    return F.transform(
        packed, lambda x: F.struct(F.shiftright(x, BITS).alias("hash"), position(x).cast("int").alias("position"))
    )


def digest(packed: Column) -> Column:
    """A short string that is equal for equal fingerprints: 128 bits of hash in hexadecimal digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), packed)), 16, "0") for i in (1, 2))))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among those of two sets."""

    def of(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        either = F.size(x) + F.size(y) - both
        return F.when(either == 0, F.lit(1.0)).otherwise(both / either)

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, prints, hashes, next_text and next_hashes: each text with the next by ascending doc_id.

    Ids are cut into ranges of about equal size at quantiles over all ids. Texts move once, to
    their range; each range also gets the first document of the following one, so that the
    next document is always in the same partition. The last range gets the first document.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    cuts = own.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 40 * n).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    block = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c <= key)) if cuts else F.lit(0)
    rows = own.withColumn("block", block)
    # One row per range: at most n.
    firsts = sorted((r["block"], r["first"]) for r in rows.groupBy("block").agg(F.min(key).alias("first")).collect())
    after = [(firsts[i][0], firsts[(i + 1) % len(firsts)][1]) for i in range(len(firsts))]
    ghosts = spark.createDataFrame(after, "block int, first long")
    guests = own.join(F.broadcast(ghosts), key == F.col("first")).select("doc_id", "text", "block", F.lit(True).alias("ghost"))
    order = Window.partitionBy("block").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    every = rows.withColumn("ghost", F.lit(False)).unionByName(guests).repartition(n // 4, "block")
    return (
        every.withColumn("prints", winnow(F.col("text")))
        .withColumn("hashes", hashes(F.col("prints")))
        .withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "hashes")})
        .filter(~F.col("ghost"))
        .drop("ghost", "block")
    )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of the text with its last quarter exchanged, and of the next one."""
    n, e = F.col("n_chars"), F.col("n_edit")
    edited = (
        with_next(docs)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("n_edit", F.floor(n / 4))
        .withColumn(
            "edited",
            F.concat(
                F.substr("text", F.lit(1), (n - e).cast("int")), F.substr("next_text", F.lit(1), e.cast("int"))
            ),
        )
    )
    same = (n - e).cast("int")
    return edited.withColumn("edited_prints", winnow_edited(F.col("prints"), F.col("text"), F.col("edited"), same)).select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        digest(F.col("prints")).alias("fingerprint"),
        digest(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes(F.col("edited_prints"))).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
