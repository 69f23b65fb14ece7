"""Word and character n-gram features with TF-IDF weights, as tables.

Terms are counted by ``functions.grams`` inside the tasks, many texts at once, and statistics
of terms combine there before they are exchanged. To weigh terms, tickets are dealt to shards by
their id. A shard's different terms, each once, are looked up in the vocabulary and come back to
its texts, so that no task and no driver holds the vocabulary and no ticket's terms are exchanged.
Terms are exchanged many to a row, dealt to parts by their hash; the parts grow in number with the texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage import fixed_values as fv
from triage.functions import grams as gr
from triage.functions import text as tx
from triage.functions.binding import column
from triage.operators.profile import whole
from triage.sources.folders import write_table, write_through

BLOCKS = ("word", "char")
BLOCK_WEIGHTS = {"word": fv.WORD_BLOCK_WEIGHT, "char": fv.CHAR_BLOCK_WEIGHT}

SPANS = {"word": fv.WORD_NGRAMS, "char": fv.CHAR_NGRAMS}

# What a shard's terms may take in a task, and what is reckoned for a code point of its texts.
BROADCAST_BYTES = 256 * 1024 * 1024
CHAR_BYTES = 128
# A row of a term table is counted as its term and its fixed part.
ROW_BYTES = 120
# Shards are dealt to twice as many partitions, up to so many.
MOST_PARTS = 2000
# Code points whose different terms a part takes when terms are counted, and shards whose terms it takes when they
# are looked up, unless the rows of the term table are more than so many times as many.
PART_CHARS = 4_000_000
PART_SHARDS = 3
PART_ROWS = 1_000_000


def block_terms(text: Column | str, block: str) -> Column:
    """All n-grams of one block of a cleaned text, repeats included."""
    return tx.word_ngrams(text) if block == "word" else tx.char_ngram_bag(text)


def count_terms(
    df: DataFrame,
    text: str = "text",
    *,
    blocks: Sequence[str] = BLOCKS,
    id_column: str = "ticket_id",
    keep: Sequence[str] = (),
    keep_empty: bool = False,
    combined: bool = False,
    n_chars: int | None = None,
) -> DataFrame:
    """``(ticket_id, …keep, block, term, tf)``: a map-only stage.

    ``keep_empty`` leaves one record with a null term for tickets without terms, and
    marks the first record of each ticket in a column ``first``. ``combined`` gives
    ``(block, term, df, tf)`` instead, one row for each term with its tickets and occurrences; what
    the tasks count is written first. ``n_chars`` is the size of the texts, if it is known.
    """
    tx.require_string(df, text)
    if combined:
        n_chars = table_chars(df, text)[1] if n_chars is None else n_chars
        n = max(1, -(-n_chars // PART_CHARS))
        counted = _prepared(df, text, blocks).mapInArrow(gr.counting(tuple(blocks), SPANS, n), gr.DEALT)
        return _grouped(write_through(counted, "counted-terms"), "_part", n).applyInArrow(gr.summing, gr.COUNTED)

    def of_block(block: str) -> Column:
        return tx.term_counts(block_terms(F.col("_clean"), block), block=F.lit(block))

    cleaned = df.select(id_column, *keep, tx.clean_text_or_empty(text).alias("_clean"))
    found = F.concat(*[of_block(b) for b in blocks])
    if not keep_empty:
        return cleaned.select(id_column, *keep, F.inline(found))
    placed = cleaned.select(id_column, *keep, F.posexplode_outer(found).alias("_at", "_item"))
    first = F.coalesce(F.col("_at") == 0, F.lit(True))
    return placed.select(id_column, *keep, "_item.*", first.alias("first"))


def table_chars(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows of a table and code points of its texts."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.char_length(text)), F.lit(0)).alias("chars")).first()
    return row["rows"], row["chars"]


def _grouped(rows: DataFrame, key: str, n: int):
    """The rows grouped by one of ``n`` numbers, in so many partitions that a task takes few of them."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * n, MOST_PARTS))
    return rows.repartition(parts, key).groupBy(key)


def _prepared(df: DataFrame, text: str, blocks: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and what each block's terms are counted from, as a column named after it."""
    tx.require_string(df, text)
    clean = df.select(*keep, tx.clean_text_or_empty(text).alias("_char"))
    return clean.select(*keep, *(_source(b) for b in blocks))


def _source(block: str) -> Column:
    return tx.word_string("_char").alias("_word") if block == "word" else F.col("_char")


def document_frequency(counts: DataFrame) -> DataFrame:
    """``(block, term, df)`` from term counts."""
    if "df" in counts.columns:  # added up by term already
        return counts.select("block", "term", "df")
    return counts.groupBy("block", "term").agg(F.count(F.lit(1)).alias("df"))


def prune(
    frequencies: DataFrame,
    n_docs: Column,
    *,
    min_df: int = fv.MIN_DF,
    max_df: float = fv.MAX_DF,
) -> DataFrame:
    """Terms in at least ``min_df`` tickets and at most the share ``max_df`` of them."""
    df = F.col("df")
    return frequencies.where((df >= min_df) & (df <= F.lit(float(max_df)) * n_docs))


def with_index(terms: DataFrame) -> DataFrame:
    """Number the terms from 0, words before character n-grams, each in byte order.

    Parts are ranges of about equal size, so no task sorts all terms of a common beginning.
    """
    block_no = F.array_position(F.array(*[F.lit(b) for b in BLOCKS]), F.col("block"))
    in_order = terms.withColumn("_block_no", block_no).orderBy("_block_no", "term")
    return numbered(in_order.drop("_block_no"), "idx", "sorted-terms")


def numbered(in_order: DataFrame, name: str, purpose: str) -> DataFrame:
    """The rows numbered from 0 in a column ``name``.

    The table is written with a number that counts within its part; adding the sizes of the parts
    before gives the place.
    """
    placed = write_through(in_order.withColumn("_at", F.monotonically_increasing_id()), purpose).withColumn(
        "_part", F.shiftright("_at", PART_BITS)
    )
    before = whole().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0).cast("long")).alias("_start"))
    )
    row = F.col("_at").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    return placed.join(F.broadcast(starts), "_part").select(*in_order.columns, (F.col("_start") + row).alias(name))


# monotonically_increasing_id counts a part's rows in the lower bits; parts are at most as many
# as shuffle partitions, so their sizes are a small table.
PART_BITS = 33


def with_idf(kept: DataFrame, n_docs: Column) -> DataFrame:
    """Add idf = ln((1+n)/(1+df)) + 1."""
    return kept.withColumn("idf", F.log((1 + n_docs) / (1 + F.col("df"))) + 1.0)


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary, held as a written table, and its sizes."""

    terms: DataFrame
    n_terms: int
    n_bytes: int
    n_docs: int


def fit_tfidf(
    df: DataFrame,
    text: str = "text",
    *,
    blocks: Sequence[str] = BLOCKS,
    min_df: int = fv.MIN_DF,
    max_df: float = fv.MAX_DF,
    id_column: str = "ticket_id",
    n_docs: int | None = None,
) -> TfidfModel:
    """Write the vocabulary ``(block, term, df, idf, idx)``; counts the tickets unless told.

    The kept terms are written before they are numbered, because numbering reads them
    twice and counting them is the costly part.
    """
    rows, n_chars = table_chars(df, text)
    n_docs = rows if n_docs is None else n_docs
    counted = document_frequency(
        count_terms(df, text, blocks=blocks, id_column=id_column, combined=True, n_chars=n_chars)
    )
    kept = write_through(
        prune(counted, F.lit(n_docs), min_df=min_df, max_df=max_df), "kept-terms"
    )
    terms = write_through(with_index(with_idf(kept, F.lit(n_docs))), "vocabulary")
    return TfidfModel(terms, *table_size(terms), n_docs)


def table_size(terms: DataFrame) -> tuple[int, int]:
    """Rows and approximate bytes of a term table."""
    letters = F.coalesce(F.sum(F.octet_length("term")), F.lit(0))
    row = terms.agg(F.count(F.lit(1)).alias("rows"), letters.alias("letters")).first()
    return row["rows"], row["letters"] + ROW_BYTES * row["rows"]


def look_up_terms(
    df: DataFrame,
    terms: DataFrame,
    text: str = "text",
    *,
    blocks: Sequence[str] = BLOCKS,
    id_column: str = "ticket_id",
    keep: Sequence[str] = (),
):
    """The cleaned texts of each shard together with its terms' rows of a term table, grouped by shard.

    Tickets of one id are in one shard. Text rows have a null in ``_packed``; the others hold many
    terms each, by their places among the shard's different terms.
    """
    own = list(dict.fromkeys([id_column, *keep]))
    texts = write_through(_prepared(df, text, ("char",), own), "texts")
    chars = texts.agg(F.coalesce(F.sum(F.char_length("_char")), F.lit(0))).first()[0]
    n = max(1, -(-chars * CHAR_BYTES // BROADCAST_BYTES))
    shard = F.pmod(F.xxhash64(id_column), F.lit(n)).cast("long").alias("_shard")
    dealt = texts.select(shard, *own, "_char")

    def by_shard(rows: DataFrame):
        rest = [c for c in rows.columns if c != "_char"]
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * n, MOST_PARTS))
        return rows.repartition(parts, "_shard").select(*rest, *(_source(b) for b in blocks)).groupBy("_shard")

    values = [c for c in ("idf", "idx", "coef") if c in terms.columns]
    table = terms.where(F.col("block").isin(*blocks)).select("block", "term", *values)
    n_parts = max(1, -(-n // PART_SHARDS), -(-table.count() // PART_ROWS))
    asked = by_shard(dealt.select("_shard", "_char")).applyInArrow(gr.naming(tuple(blocks), SPANS, n_parts), gr.DEALT)
    both = asked.unionByName(table.mapInArrow(gr.shelving(n_parts), gr.DEALT))
    found = write_through(_grouped(both, "_part", n_parts).applyInArrow(gr.answering, gr.DEALT).drop("_part"), "found-terms")
    return by_shard(dealt.unionByName(found, allowMissingColumns=True))


def tfidf(
    df: DataFrame,
    model: TfidfModel,
    text: str = "text",
    *,
    blocks: Sequence[str] = BLOCKS,
    id_column: str = "ticket_id",
    weighted: bool = True,
    combined: str | None = None,
) -> DataFrame:
    """``(ticket_id, block, term, idx, weight)``: (1 + ln tf) · idf, unit length per block.

    Blocks are scaled by their weight unless ``weighted`` is off. ``combined`` gives partial sums
    ``(…, terms, total, highest)`` of the weights by "ticket" and block or by block and "term",
    among those that a task holds at once.
    """
    scales = {b: BLOCK_WEIGHTS[b] if weighted else 1.0 for b in blocks}
    sums = "terms long, total double, highest double"
    own = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, "
    schema = {
        None: f"{own}block string, term string, idx long, weight double",
        "ticket": f"{own}block string, {sums}",
        "term": f"block string, term string, {sums}",
    }[combined]
    shards = look_up_terms(df, _weighing(model.terms), text, blocks=blocks, id_column=id_column)
    return shards.applyInArrow(gr.scaled_terms(tuple(blocks), SPANS, id_column, scales, combined), schema)


def _weighing(terms: DataFrame) -> DataFrame:
    return terms.select("block", "term", "idf", "idx")


def block_scale(block: Column | str = "block") -> Column:
    return F.when(column(block) == "word", BLOCK_WEIGHTS["word"]).otherwise(BLOCK_WEIGHTS["char"])


VECTOR_FIELDS = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def sparse_rows(
    df: DataFrame,
    model: TfidfModel,
    text: str = "text",
    *,
    keep: Sequence[str] = ("category",),
    id_column: str = "ticket_id",
) -> DataFrame:
    """``(ticket_id, …keep, indices, values)``: each ticket's weights by term number.

    Rows of one id and equal ``keep`` are one ticket.
    """
    own = list(dict.fromkeys([id_column, *keep]))
    schema = T.StructType(
        [T.StructField(c, df.schema[c].dataType) for c in own]
        + [T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    )
    shards = look_up_terms(df, _weighing(model.terms), text, id_column=id_column, keep=keep)
    return shards.applyInArrow(gr.sparse_entries(BLOCKS, SPANS, own, BLOCK_WEIGHTS), schema)


def sparse_sums(
    df: DataFrame,
    terms: DataFrame,
    n_classes: int,
    text: str = "text",
    *,
    keep: Sequence[str] = ("category",),
    id_column: str = "ticket_id",
) -> DataFrame:
    """``(ticket_id, …keep, sums)``: for each row of ``sparse_rows`` its values times the coefficients of each
    class in ``terms``, added up where the values are found, so that no entry is exchanged or written.
    """
    own = list(dict.fromkeys([id_column, *keep]))
    schema = T.StructType([*(df.schema[c] for c in own), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    shards = look_up_terms(df, terms, text, id_column=id_column, keep=keep)
    return shards.applyInArrow(gr.entry_sums(BLOCKS, SPANS, own, BLOCK_WEIGHTS, n_classes), schema)


def vectors(rows: DataFrame, n_terms: int) -> DataFrame:
    """``sparse_rows`` as ML vectors in a column ``features``, for use with MLlib.

    The table is written to the work folder in the vectors' storage layout and read
    back as vectors, so no row passes through Python.
    """
    from pyspark.ml.linalg import VectorUDT

    keep = [c for c in rows.columns if c not in ("indices", "values")]
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(n_terms).alias("size"),
        F.col("indices"),
        F.col("values"),
    )
    table = rows.select(*keep, vector.cast(VECTOR_FIELDS).alias("features"))
    path = write_table(table, "vectors")
    schema = T.StructType([*table.schema.fields[:-1], T.StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)
