"""Whole books: from a folder of sources to pages, style sheets and assets, a function for each format; P31, P32.

Each gathers the folder's files, checks that there are sources of the format, unpacks them, and gives a :class:`Book` of tables
with a row for each page, sheet and asset. ``publish`` writes them. A folder may hold any number of books; each is a ``doc_id``, its path.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry, text
from folioflow.operators import markup
from folioflow.sources import docx, epub, files, idml, sinks, spreads
from folioflow.storage import written


@dataclass
class Book:
    """``pages``: doc_id, page_no, title, html. ``sheets``: doc_id, css. ``assets``: doc_id, ord, path, content, is_cover."""

    pages: DataFrame
    sheets: DataFrame
    assets: DataFrame


def _assets(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("path")
    return rows.select("doc_id", F.row_number().over(order).alias("ord"), "path", "content", "is_cover")


def word(members: DataFrame) -> Book:
    """Pages begin at headings of the first level and at page breaks; styles of paragraphs and runs are in the pages."""
    pages = docx.body_pages(members).select(F.col("path").alias("doc_id"), "page_no", "title", "html")
    css = F.concat(F.lit("."), text.class_name(F.coalesce("style", F.lit("")), ""), F.lit(" { "), "css", F.lit(" }"))
    rules = docx.style_properties(members).where("css <> ''").select(F.col("path").alias("doc_id"), F.col("style").alias("ord"), css.alias("rule"))
    pictures = docx.picture_files(members).select(F.col("path").alias("doc_id"), F.concat(F.lit("images/"), "name").alias("path"), "content", F.lit(False).alias("is_cover"))
    return Book(pages, sinks.style_sheet(rules, ["doc_id"]), _assets(pictures))


def packages(members: DataFrame) -> Book:
    """EPUB: a page for each item of the spine that is there, in its order, with the label of its first entry in the contents; style sheets and other files by kind."""
    pkg = epub.packages(members)
    base = pkg.where("node_id = 0").select("path", "base")
    spine = epub.spine_files(pkg).join(base, "path").select("path", F.col("ord").alias("page_no"), F.concat("base", "href").alias("member"))
    labels = epub.ncx(members).unionByName(epub.nav(members)).join(base, "path")
    labels = labels.groupBy("path", F.concat("base", F.substring_index("href", "#", 1)).alias("member")).agg(F.min_by("label", "ord").alias("title"))
    html = text.without_declaration(F.decode("content", "UTF-8"))
    html = text.body(markup.math_namespace(markup.table_styles(html)))
    pages = members.join(spine, ["path", "member"]).join(labels, ["path", "member"], "left").select(F.col("path").alias("doc_id"), "page_no", "title", html.alias("html"))
    place = F.when(files.route(F.col("member")).isNotNull(), F.concat(files.route(F.col("member")), F.regexp_extract("member", "([^/]*)$", 1)))
    cover = F.lower(F.regexp_extract("member", "([^/]*)$", 1)).rlike(r"^cover\.")
    assets = members.where(place.isNotNull()).select(F.col("path").alias("doc_id"), place.alias("path"), "content", cover.alias("is_cover"))
    rules = members.where(F.lower("member").endswith(".css")).select(F.col("path").alias("doc_id"), F.col("member").alias("ord"), F.decode("content", "UTF-8").alias("rule"))
    return Book(pages, sinks.style_sheet(rules, ["doc_id"]), _assets(assets))


def layouts(members: DataFrame) -> Book:
    """IDML: a page for each page of its spreads, with its masters' items below its own, each frame where it lies and with the text of its story.

    A story that goes through several frames is shown in the first. What is hidden by a tag, and what lies on the pasteboard, isn't shown.
    """
    tree = spreads.spread_nodes(members)
    pages, items = written(spreads.pages(tree)), written(spreads.items(tree))
    hidden = idml.hidden_ids(members)
    items = items.join(hidden.select("path", F.col("id").alias("item")), ["path", "item"], "left_anti")
    placed = spreads.page_of_items(items, pages)
    shown = spreads.page_items(pages, placed)
    frames = items.where("level = 0").select("path", F.col("node").alias("ord"), "item", "story", geometry.transformed(F.col("box"), F.col("transform")).alias("at"))
    # where it lies on its own page, which may be a master's
    own = placed.where("item <=> top and page is not null").select("path", "item", F.col("page").alias("of")).join(pages.select("path", F.col("page").alias("of"), "box"), ["path", "of"])
    frames = frames.join(own, ["path", "item"]).withColumn("place", geometry.on_page(F.col("at"), F.col("box"), F.lit(0))).withColumn("size", geometry.size_and_center(F.col("at")))
    rows = shown.join(frames.select("path", "ord", "item", "story", "place", "size"), ["path", "ord", "item"])
    stories = idml.story_html(members)
    rows = rows.join(stories, ["path", "story"], "left")
    numbered = F.row_number().over(Window.partitionBy("path").orderBy("member", "ord"))
    order = pages.where("not is_master").select("path", "page", "spread", "ord", F.col("name").alias("title"), "box")
    first = F.row_number().over(Window.partitionBy("path", "page", "story").orderBy(F.desc("level"), "ord"))
    rows = rows.withColumn("nth", F.when(F.col("story").isNotNull(), first).otherwise(1)).withColumn("html", F.when(F.col("nth") == 1, F.col("html")))
    px = lambda v: F.concat(F.round(v).cast("int").cast("string"), F.lit("px"))
    style = F.concat(F.lit("position:absolute;left:"), px(F.col("place.left")), F.lit(";top:"), px(F.col("place.top")), F.lit(";width:"), px(F.col("size.width")), F.lit(";height:"), px(F.col("size.height")))
    div = F.concat(F.lit('<div id="'), F.coalesce("item", F.lit("")), F.lit('" style="'), style, F.lit('">'), F.coalesce("html", F.lit("")), F.lit("</div>"))
    held = F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("level"), "ord", div.alias("div"))))
    made = rows.groupBy("path", "page").agg(F.array_join(F.transform(held, lambda x: x.div), "").alias("html"))
    spread_order = tree.where("node_id = spread_node").select("path", "member", "spread").distinct()
    out = order.join(spread_order, ["path", "spread"]).withColumn("page_no", numbered).join(made, ["path", "page"], "left")
    out = out.select(F.col("path").alias("doc_id"), "page_no", "title", F.coalesce("html", F.lit("")).alias("html"))
    sheets = idml.style_sheets(members).select(F.col("path").alias("doc_id"), F.col("style").alias("ord"), F.col("css").alias("rule"))
    none = members.limit(0).select(F.col("path").alias("doc_id"), F.col("member").alias("path"), "content", F.lit(False).alias("is_cover"))
    return Book(out, sinks.style_sheet(sheets, ["doc_id"]), _assets(none))


def pictures(sources: DataFrame) -> Book:
    """Images: a page for each, by path; the folder is the book."""
    rows = sources.withColumn("doc_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))
    pages = rows.select("doc_id", n.alias("page_no"), F.col("name").alias("title"), F.concat(F.lit('<img src="images/'), text.escape(F.col("name")), F.lit('" />')).alias("html"))
    assets = rows.select("doc_id", F.concat(F.lit("images/"), "name").alias("path"), "content", F.lit(False).alias("is_cover"))
    return Book(pages, pages.limit(0).select("doc_id", F.lit("").alias("css")), _assets(assets))


#: How the members of a format's archives become a book; images are no archives.
FORMATS: dict[str, Callable[[DataFrame], Book]] = {"word": word, "epub": packages, "idml": layouts}


def format_of(folder_files: DataFrame) -> str:
    """The one format that a folder's files have sources of; several or none are an error; S1."""
    kinds = F.array(*(F.when(files.is_source(F.col("path"), ext), kind) for kind, ext in files.SOURCES.items()))
    found = [r.kind for r in folder_files.select(F.explode(F.array_compact(kinds)).alias("kind")).distinct().orderBy("kind").collect()]
    # pictures beside a document belong to it
    real = [k for k in found if k != "images"] or found
    if len(real) != 1:
        raise ValueError(f"one source format is needed, not {real}")
    return real[0]


def converted(spark: SparkSession, folder: str, kind: str | None = None) -> Book:
    """The books in a folder, of a format by name or by their files; P31, S1."""
    kind = kind or format_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path"))
    sources = files.gathered(spark, folder, kind).where("role = 'source'").select("path", "content")
    if kind == "images":
        return pictures(sources)
    if kind not in FORMATS:
        raise ValueError(f"no converter for {kind!r}")
    return FORMATS[kind](written(files.members(sources)))


def publish(book: Book, folder: str) -> None:
    """Writes pages, style sheets, assets and covers as Parquet tables below ``folder``; K1, K2, K3, K5, K7."""
    sinks.write_pages(book.pages, f"{folder}/pages")
    book.sheets.write.mode("overwrite").parquet(f"{folder}/sheets")
    assets = written(book.assets)
    assets.drop("is_cover").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ord").write.mode("overwrite").parquet(f"{folder}/assets")
    sinks.cover(assets).write.mode("overwrite").parquet(f"{folder}/covers")
