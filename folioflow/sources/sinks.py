"""Sinks: pages, style sheets and assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pages(rows: DataFrame) -> DataFrame:
    """doc_id, page_no, title, html as whole XHTML pages; an empty title is "Untitled"; K1."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
    html = F.concat(F.lit("<!DOCTYPE html>\n<html><head><title>"), title, F.lit('</title><link rel="stylesheet" type="text/css" href="style.css" /></head><body>'), "html", F.lit("</body></html>"))
    return rows.select("doc_id", "page_no", title.alias("title"), html.alias("html"))


def write_pages(rows: DataFrame, folder: str) -> None:
    """Parquet files by ranges of documents, in order, so that a document's pages are found by the files' statistics; K1, K5."""
    pages(rows).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "page_no").write.mode("overwrite").parquet(folder)


def style_sheet(rules: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and css: the distinct rules of each key in the order they were first seen; K2, A5."""
    first = rules.groupBy(*keys, "rule").agg(F.min("ord").alias("ord"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "rule")))
    return first.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda s: s.rule), "\n").alias("css"))


def cover(assets: DataFrame) -> DataFrame:
    """doc_id, cover: the first asset that is declared as one, else an empty path; K7."""
    declared = F.min_by(F.when(F.col("is_cover"), F.col("path")), F.when(F.col("is_cover"), F.col("ord")))
    return assets.groupBy("doc_id").agg(F.coalesce(declared, F.lit("")).alias("cover"))
