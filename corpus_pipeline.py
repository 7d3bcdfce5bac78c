"""A corpus pipeline: language ID, line dedup, near-dedup, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns what the next stage gets as its docs. All but the last return the columns
of ``documents``.

Defined results: each stage takes nulls in any column, empty and very long texts, ties, repeated
rows, empty tables and further columns of any name, which it carries along; what it does with each is
said with the stage. An empty table gives an empty result of the same columns at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import language_id, line_dedup, near_dedup, packing, scratch

#: A document whose language is less likely than this, or that has no letter, is rejected.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, with that language in ``lang``.

    Null, empty and letterless texts go; whole texts are scored, however long; a document's label, source and id
    don't matter, so equal texts fare alike and each repeated row stays or goes by itself. Without labels nothing is recognised.
    """
    found = language_id.annotate(docs, language_id.train(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("lang_pred").alias("lang") if c == "lang" else c for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come earlier in the corpus; those that lose all their lines go.

    Earlier is by doc_id (null first), then text, then place; ``n_chars`` is that of what stays. Of repeated rows, which share id and
    text, all keep what one keeps. A text without repeated lines stays as it is.
    """
    cleaned = line_dedup.deduplicate(docs)
    kept = cleaned.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return kept.select(*(F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else c for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id.

    A null id is the largest; ties go by a hash of the text, then by the other columns, so of repeated rows one stays. Rows without
    a word are near nothing and all stay.
    """
    return near_dedup.distinct(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its sequence and offset.

    An empty text is a piece of its end id alone; longer documents than a sequence are cut; repeated rows and
    equal or null ids are packed row by row; further columns end here.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("best-fit packing", packing_stage),
]

#: Language ID, sketches and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
