"""Files as rows: classification, routing, and the members of archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of each kind of asset; an extension in two lists takes the first.
ASSETS = {"images/": ("png", "jpg", "jpeg", "gif", "svg"), "fonts/": ("otf", "ttf", "woff", "svg"), "audio/": ("mp3", "m4a", "wav"), "video/": ("mp4", "m4v", "mov")}
SOURCES = {"epub": ("epub",), "word": ("docx", "doc"), "idml": ("idml",), "pdf": ("pdf",), "images": ("png", "jpg", "jpeg", "gif", "tif", "tiff", "bmp")}


_KEY = "key"


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def is_source(path: Column, extensions: tuple[str, ...]) -> Column:
    """By the lower-cased extension; F1."""
    return F.lower(extension(path)).isin(*extensions)


def route(path: Column) -> Column:
    """The asset directory by the extension as written; null for an unknown one; K4, S21."""
    out = F.lit(None).cast("string")
    for place, names in reversed(ASSETS.items()):
        out = F.when(extension(path).isin(*names), place).otherwise(out)
    return out


def gathered(spark: SparkSession, folder: str, kind: str, least: int = 1) -> DataFrame:
    """path, content, role of a folder's files; fewer than ``least`` sources is an error; S1, S2."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source type {kind!r}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = files.select("path", "content", F.when(is_source(F.col("path"), SOURCES[kind]), "source").otherwise("asset").alias("role"))
    if files.select("path").where(is_source(F.col("path"), SOURCES[kind])).limit(least).count() < least:
        raise ValueError(f"fewer than {least} sources of type {kind!r}")
    return rows


def members(archives: DataFrame, permissive: bool = False) -> DataFrame:
    """path, member, content: each file of each zip archive in ``archives(path, content)``; S3, S4, S13.

    A broken or empty archive is an error, or, after the members that can be read, a row with a null member if ``permissive``.
    """

    def run(batches):
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.infolist() if not n.is_dir()]
                        if not names:
                            raise zipfile.BadZipFile("no members")
                        for n in names:  # one member is held at a time
                            yield pd.DataFrame([(path, n.filename, z.read(n))], columns=["path", "member", "content"])
                except zipfile.BadZipFile as e:
                    if not permissive:
                        raise ValueError(f"{path}: {e}") from e
                    yield pd.DataFrame([(path, None, None)], columns=["path", "member", "content"])

    return archives.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def images(files: DataFrame) -> DataFrame:
    """path and a padded sequential name for each image, by path; S18."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("book").orderBy("path"))
    return files.withColumn("book", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).select("path", F.concat(F.lpad(n.cast("string"), 4, "0"), F.lit(".png")).alias("name"))


def pdf_info(text: Column) -> Column:
    """The keys and values of a PDF tool's listing, split at the first colon; of a repeated key the first; S17."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias(_KEY), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")))
    keys = F.transform(pairs, lambda p: p[_KEY])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p[_KEY]) == i + 1))


def empty_book(spark: SparkSession) -> DataFrame:
    """One page for a book without sources; S20."""
    return spark.createDataFrame([(1, "Page 1", "")], "page_no int, title string, html string")


def page_files(files: DataFrame) -> DataFrame:
    """book, page_no, path of the pages in a PDF converter's output folders, ``files(path)``, by the number in the name; S16."""
    number = F.regexp_extract("path", r"(?i)(?:^|/)page0*([0-9]+)\.x?html$", 1)
    rows = files.select(F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("book"), number.try_cast("int").alias("page_no"), "path")
    return rows.where("page_no is not null")
