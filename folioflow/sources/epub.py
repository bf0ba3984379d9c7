"""EPUB packages: container, manifest, spine, metadata and tables of contents.

``members`` are the rows of :func:`folioflow.sources.files.members`. All are read from the trees of
:func:`folioflow.sources.xml.nodes`, so prefixes, comments, entities and inline markup are as in any XML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import lookup
from folioflow.sources.xml import nodes, owned
from folioflow.storage import written

PACKAGE, NCX = "application/oebps-package+xml", "application/x-dtbncx+xml"


def _attr(name: str):
    return F.try_element_at("attrs", F.lit(name))


def package_paths(members: DataFrame) -> DataFrame:
    """path, opf: the first rootfile of the package type; S5."""
    rows = nodes(members.where("member = 'META-INF/container.xml'")).where((F.col("tag") == "rootfile") & (_attr("media-type") == PACKAGE))
    return rows.groupBy("path").agg(F.min_by(_attr("full-path"), "node_id").alias("opf"))


def packages(members: DataFrame) -> DataFrame:
    """path, base and the nodes of each package document, as a written table: all that is read from it takes one parse."""
    docs = members.where(F.col("member").rlike(r"\.opf$"))
    named = docs.join(package_paths(members), "path").where(F.col("member") == F.col("opf"))
    rows = nodes(named, ("title", "publisher", "language", "identifier"))
    return written(rows.withColumn("base", F.regexp_extract("member", "^(.*/)?[^/]*$", 1)))


def versions(pkg: DataFrame) -> DataFrame:
    """S6."""
    return pkg.where("node_id = 0").select("path", F.floor(_attr("version").try_cast("double")).cast("int").alias("version"))


def _numbered(rows: DataFrame, start: int) -> DataFrame:
    from folioflow.operators.runs import numbered

    return numbered(rows, ["path"], ["node_id"], "n", start)


def manifest(pkg: DataFrame) -> DataFrame:
    """path, ord (from 0), id, href, media_type; S7."""
    rows = _numbered(owned(pkg, "manifest").where("manifest is not null and tag = 'item'"), 0)
    return rows.select("path", F.col("n").alias("ord"), *(F.coalesce(_attr(a), F.lit("")).alias(a.replace("-", "_")) for a in ("id", "href", "media-type")))


def spine(pkg: DataFrame) -> DataFrame:
    """path, ord (from 1), idref; S8."""
    rows = _numbered(owned(pkg, "spine").where("spine is not null and tag = 'itemref'"), 1)
    return rows.select("path", F.col("n").alias("ord"), F.coalesce(_attr("idref"), F.lit("")).alias("idref"))


def spine_files(pkg: DataFrame) -> DataFrame:
    """path, ord, href: the spine with each item's first manifest entry; J1."""
    first = lookup.first_of(manifest(pkg), ["path", "id"], ["ord"], ["href"])
    return lookup.looked_up(spine(pkg), first, {"path": "path", "idref": "id"}, {"href": None}).select("path", "ord", "href")


def metadata(pkg: DataFrame) -> DataFrame:
    """path, title, publisher, language, isbn: the first of each; S9."""
    first = lambda on, name: F.nullif(F.min_by(F.when(on, F.col("content")), F.when(on, F.col("node_id"))), F.lit("")).alias(name)
    tag = F.col("tag")
    return pkg.groupBy("path").agg(*(first(tag == t, t) for t in ("title", "publisher", "language")), first((tag == "identifier") & (_attr("id") == "ISBN"), "isbn"))


def contents_files(members: DataFrame) -> DataFrame:
    """``members`` that a package's manifest says are tables of contents, by media type or the property nav, with kind ncx or nav; S12."""
    pkg = packages(members)
    items = pkg.where("tag = 'item'").select("path", F.concat("base", _attr("href")).alias("member"), _attr("media-type").alias("type"), F.split(F.coalesce(_attr("properties"), F.lit("")), r"\s+").alias("properties"))
    kind = F.when(F.col("type") == NCX, "ncx").when(F.array_contains("properties", "nav"), "nav")
    return members.join(items.select("path", "member", kind.alias("kind")).where("kind is not null"), ["path", "member"])


def ncx(members: DataFrame) -> DataFrame:
    """path, ord, level, id, label, href of each navPoint; S10.

    Points nest in each other, so a point's level is its depth below the map. A label is the whole text of its text element.
    """
    tree = written(owned(nodes(contents_files(members).where("kind = 'ncx'"), ("text",)), "navMap").where("navMap is not null"))
    top = tree.where("tag = 'navMap'").select("path", F.col("node_id").alias("navMap"), F.col("depth").alias("top"))
    points = tree.where("tag = 'navPoint'").join(top, ["path", "navMap"]).select("path", "node_id", (F.col("depth") - F.col("top") - 1).alias("level"), F.coalesce(_attr("id"), F.lit("")).alias("id"))
    texts = tree.where("tag = 'text'").select("path", F.col("parent_id").alias("up"), "node_id", "content")
    labels = tree.where("tag = 'navLabel'").select("path", F.col("node_id").alias("up"), F.col("parent_id").alias("point")).join(texts, ["path", "up"])
    labels = lookup.first_of(labels, ["path", "point"], ["node_id"], ["content"])
    hrefs = lookup.first_of(tree.where("tag = 'content'").select("path", F.col("parent_id").alias("point"), "node_id", _attr("src").alias("src")), ["path", "point"], ["node_id"], ["src"])
    on = {"path": "path", "node_id": "point"}
    rows = lookup.looked_up(lookup.looked_up(points, labels, on, {"content": ""}), hrefs, on, {"src": ""})
    return rows.select("path", F.col("node_id").alias("ord"), "level", "id", F.trim("content").alias("label"), F.col("src").alias("href"))


def nav(members: DataFrame) -> DataFrame:
    """path, ord, level, id, label, href of each entry of the EPUB 3 table of contents; S11.

    Lists nest as ol in li, two levels of depth each. An entry is the first link of its item, with the whole
    text inside it; those without label or href are left out, with all entries below them.
    """
    tree = written(nodes(contents_files(members).where("kind = 'nav'"), ("a",)))
    tops = tree.where((F.col("tag") == "nav") & F.array_contains(F.split(F.coalesce(_attr("type"), F.lit("")), r"\s+"), "toc"))
    tops = tops.select("path", F.col("node_id").alias("top"), F.col("last").alias("end"), F.col("depth").alias("top_depth"))
    items = tree.where("tag = 'li'").join(tops, "path").where("node_id > top and node_id <= end")
    items = items.select("path", "node_id", "last", ((F.col("depth") - F.col("top_depth")) / 2 - 1).cast("int").alias("level"), F.coalesce(_attr("id"), F.lit("")).alias("id"))
    links = tree.where("tag = 'a'").select("path", F.col("parent_id").alias("item"), "node_id", "content", _attr("href").alias("href"))
    links = lookup.first_of(links, ["path", "item"], ["node_id"], ["content", "href"])
    rows = lookup.looked_up(items, links, {"path": "path", "node_id": "item"}, {"content": None, "href": None})
    bad = F.coalesce(F.trim("content") == "", F.lit(True)) | F.coalesce(F.trim("href") == "", F.lit(True))
    # entries are in preorder: what lies before the furthest end of a bad one is below it
    end = F.max(F.when(bad, F.col("last"))).over(Window.partitionBy("path").orderBy("node_id"))
    rows = rows.withColumn("end", end).where("end is null or node_id > end")
    return rows.select("path", F.col("node_id").alias("ord"), "level", "id", F.trim("content").alias("label"), "href")
