"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.storage import discard, written  # noqa: F401  the operators take them from here

#: Pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch of rows between Spark and Python, by ``small_batches``.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds batches that go to Python by their bytes, unless the session does: 10,000 whole texts, which is Spark's own bound, fill hundreds of MB beside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def own(df: DataFrame):
    """All columns of ``df`` as one struct, so that names of our own beside it can't clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own")


def ascii_lower(text):
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def words(text):
    """The words of a text as an array; no words for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def crc_of_id(name: str = "doc_id"):
    """crc32 of an id's decimal text; of the empty text where the id is null."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))
