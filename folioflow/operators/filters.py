"""Filters of nodes and elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the nodes of a story or spread that become page elements.
PARSABLE = (
    "Rectangle", "TextFrame", "Element", "CharacterStyleRange", "ParagraphStyleRange", "Image", "PDF", "EPS", "Group", "Story", "Change", "Content", "Br", "XMLElement",
    "Table", "Row", "Column", "Cell", "HyperlinkTextSource", "HyperlinkTextDestination", "Sound", "Movie", "TextVariableInstance", "GraphicLine", "Polygon", "Oval",
)


def parsable(tag: Column) -> Column:
    """F3."""
    return tag.isin(*PARSABLE)


def is_type(kind: Column, expected: str) -> Column:
    """Whether a source is of the type ``expected``; none is of no type; F2."""
    return kind.eqNullSafe(F.lit(expected))


def checked_type(rows: DataFrame, kind: Column, expected: str) -> DataFrame:
    """``rows``; a row of another source type than ``expected`` ends the job; F2."""
    right = F.when(is_type(kind, expected), True).otherwise(F.raise_error(F.concat(F.lit(f"expected a source of type {expected}, not "), F.coalesce(kind, F.lit("none")))).cast("boolean"))
    return rows.where(right)


def in_story(tag: Column, content: Column, story: Column) -> Column:
    """Whether an element is to be read with ``story``: a tagged one only without content of its own, or with that story's; F15."""
    return (tag != "XMLElement") | content.isNull() | (content == "") | content.eqNullSafe(story)


def has_value(attrs: Column, name: str) -> Column:
    """Whether an attribute is there and not empty; F23."""
    return F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit("")) != ""


def children(nodes: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """``keys``, parent_id, children (their ids in order) and last, of the direct children of a tag; F26."""
    found = F.array_sort(F.collect_list(F.struct("ord", "node_id")))
    rows = nodes.where(F.col("tag") == tag).groupBy(*keys, "parent_id").agg(F.transform(found, lambda s: s.node_id).alias("children"))
    return rows.withColumn("last", F.element_at("children", -1))


def positioned(own: Column, embedded: Column, child: Column) -> Column:
    """Whether an element has a place of its own: it or a child in line with text is placed, and it isn't embedded; F25."""
    return (F.coalesce(own, F.lit(False)) | F.coalesce(child, F.lit(False))) & ~F.coalesce(embedded, F.lit(False))


def tagged_books(tree: DataFrame, roots: tuple[str, ...] = ("etmfile", "pxe", "PXE")) -> DataFrame:
    """path, tagged: whether the backing story of a package has one of the root tags; F27."""
    root = F.regexp_replace(F.coalesce(F.try_element_at("attrs", F.lit("MarkupTag")), F.lit("")), "^XMLTag/", "").isin(*roots)
    return tree.groupBy("path").agg(F.bool_or(root).alias("tagged"))


def frame_tag(embedded: Column, in_paragraph: Column) -> Column:
    """The element of a text frame: a span inside a paragraph, an aside where embedded, else a section; P15."""
    return F.when(in_paragraph, "span").when(embedded, "aside").otherwise("section")


def instruction(kind: Column, page: Column, fixed: Column) -> Column:
    """A processing instruction's text: the page's name for 18 in a fixed layout, else nothing; P22."""
    return F.when((kind == 18) & fixed, page).otherwise("")


def crop(offset: Column, ppi: Column) -> Column:
    """Points to pixels of an image; K13."""
    return F.round(offset * ppi / 72.0)


def markup_tag(applied: Column) -> Column:
    """The tag's name of an applied markup tag, null for none; F4."""
    return F.regexp_extract(F.when(applied.rlike("^XMLTag/."), applied), "^XMLTag/(.*)$", 1)


def is_visible(value: Column) -> Column:
    """Whether an attribute of visibility says true, in any case; F6."""
    return F.lower(value) == "true"


def unchanged(rows: DataFrame, kind: Column, dropped: tuple[str, ...]) -> DataFrame:
    """Without the rows of tracked changes of the kinds ``dropped``; a row without a kind stays; F7."""
    return rows.where(~F.coalesce(kind.isin(*dropped), F.lit(False)))


def drawable(points: Column) -> Column:
    """Whether a shape has two points or more; F10."""
    return F.coalesce(F.size(points), F.lit(0)) >= 2


def is_numbered(list_id: Column, level: Column) -> Column:
    """Whether a paragraph belongs to a list: it has one, and a level in it; F21."""
    return F.coalesce((list_id > 0) & (level >= 0), F.lit(False))


def has_entry(cell: Column) -> Column:
    """Whether a contents cell has more than formatting and breaks; F22."""
    return F.trim(F.regexp_replace(cell, "</?b>|</?i>|<br ?/?>", "")) != ""
