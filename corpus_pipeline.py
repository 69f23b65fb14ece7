"""From documents to token ids: five stages, each written as Parquet and read by the next.

Every stage is a function of (spark, docs, sf_dir); all but the last return the columns of
``documents``. A null or empty text has no language and goes in the first stage. Ids may be null
or shared by different texts: every row is judged, cut, compared, drawn and encoded by its own text;
only rows equal in id and text count as copies of one row, in the stage of near duplicates.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.llm import language, line_runs, mixing, pieces, simhash
from triage.llm.queries import BOOK_SOURCES, PIECE_MODEL
from triage.llm.tables import Table

#: A text whose language is less sure than this goes.
LEAST_SCORE = 0.5
#: Weights by path in percent. Near duplicates are gone, so no document is taken twice.
WEIGHTS = {"web": 70, "books": 30, "web/en": 60, "web/de": 15, "web/fr": 15, "web/es": 10, "web/en/src0": 4}
SHARE, EPOCHS, SEED = 0.9, 1, 7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model is learned from the labelled ones."""
    return language.confident(docs, language.fit(docs), LEAST_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents that were nothing else go."""
    cut, _ = line_runs.remove_repeated_lines(docs)
    left = (F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\s]")
    return (
        cut.filter(left)
        .withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long"))
        .select(docs.columns)
    )


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of fingerprints within four bits (four-word shingles)."""
    kept, _ = simhash.first_of_groups(docs)
    return kept


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("source").isin(*BOOK_SOURCES), "books").otherwise("web")
    taken, _ = mixing.mix(docs, domain, WEIGHTS, SHARE, EPOCHS, SEED)
    return taken.select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(docs, Path(PIECE_MODEL).read_bytes())
    return encoded.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "round_trip", "parity")


STAGES = [
    ("language", identify_language),
    ("line_runs", dedup_lines),
    ("simhash", dedup_near),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SentencePiece encoding has no SQL form; tests run a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        table = Table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            last.drop()
        docs, last = table.df, table
    return docs
