"""A corpus pipeline: toxic documents go, repeated lines go, one document of each group of
near-duplicates stays, sources are mixed to their targets, and the texts become tokens.

Each stage reads all rows that its predecessor kept; its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import linededup, mixing, pieces, simhash, toxicity
from folioflow.llm.common import table
from folioflow.storage import discard, discard_since, held, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier scores at 0.5 or more."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of repeated three-line windows; ``n_chars`` follows the text."""
    return linededup.dedup_lines(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that with the least id."""
    return simhash.keep_one_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.take(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, tokens and the digest of the text that they decode to."""
    return pieces.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: SQL can express neither the trained classifier nor the segmentation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps for itself, and what it has read, is deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = held()
        out = written(stage(spark, docs, sf_dir))
        discard_since(before, out)
        discard(docs)
        docs = out
    return docs
