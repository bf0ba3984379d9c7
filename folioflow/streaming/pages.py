"""Pages as a stream: arriving files are parsed by the operators of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators import markup


def arriving(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The text blocks of arriving pages."""
    return markup.blocks(arriving(spark, folder))


def tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Running counts of tags."""
    return markup.tags(arriving(spark, folder)).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def write_blocks(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the blocks of all pages there are to ``out``, each page once."""
    return blocks(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
