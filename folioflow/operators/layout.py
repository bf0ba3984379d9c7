"""Joins of layout objects: pages, elements, links and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import closure, lookup


def first_match(left: DataFrame, right: DataFrame, on: Column, keys: list[str], order: list) -> DataFrame:
    """Each left row with the first right row that matches; J1, J2, J19."""
    joined = left.join(right, on)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return joined.withColumn("_n", n).where("_n = 1").drop("_n")


def pages_of(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """The first page of an element's spread whose rectangle has the element's centre; J14.

    elements: spread, element, x, y. pages: spread, page, ord, top, left, bottom, right. A spread is cut into
    squares as large as its largest page, so that a page lies on four of them at most and an element is compared with the
    pages on its own square alone. An element on no page is not returned.
    """
    side = F.max(F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"), F.lit(1.0))).over(Window.partitionBy("spread"))
    cut = lambda c, size: F.floor(F.col(c) / F.col(size)).cast("long")
    tiled = pages.withColumn("_side", side).withColumn("_col", F.explode(F.sequence(cut("left", "_side"), cut("right", "_side")))).withColumn("_row", F.explode(F.sequence(cut("top", "_side"), cut("bottom", "_side"))))
    sides = tiled.groupBy(F.col("spread")).agg(F.max("_side").alias("_side"))
    binned = elements.join(sides, "spread").withColumn("_col", cut("x", "_side")).withColumn("_row", cut("y", "_side")).drop("_side")
    inside = F.col("x").between(F.col("left"), F.col("right")) & F.col("y").between(F.col("top"), F.col("bottom"))
    hits = binned.join(tiled.drop("_side"), ["spread", "_col", "_row"]).where(inside)
    return hits.groupBy("spread", "element").agg(F.min_by("page", "ord").alias("page"))


def resolved_links(sources: DataFrame, destinations: DataFrame) -> DataFrame:
    """source, target, kind of each link: external for a URL, page or anchor by its destination, else broken; J3-J5."""
    external = F.col("destination").rlike("^[a-z]+://")
    out = sources.join(destinations, sources.destination == destinations.key, "left")
    kind = F.when(external, "external").when(F.col("key").isNull(), "broken").when(F.col("is_page"), "page").otherwise("anchor")
    return out.select("source", F.when(external, F.col("destination")).otherwise(F.col("target")).alias("target"), kind.alias("kind"))


def filled(rows: DataFrame, more: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Takes a value from ``more`` only where ``rows`` has none; J23."""
    extra = more.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = rows.join(extra, key, "left")
    return out.select(*(c for c in rows.columns if c not in columns), *(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) for c in columns))


def ancestors(nodes: DataFrame, keep: Column, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys``, node, ancestor: the nearest proper ancestor for which ``keep`` holds, null if none; J16.

    ``nodes``: ``keys``, node, parent and what ``keep`` reads.
    """
    return closure.above(nodes, F.when(keep, F.col("node")), F.coalesce, "ancestor", keys)


def translations(nodes: DataFrame, shift: Column, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys``, node, shift: the sum of the shifts of each node and its ancestors; C23."""
    return closure.folded(nodes, shift, lambda a, b: a + b, "shift", keys)


def master_chain(pages: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys``, node, masters, base: how many masters a page is based on, and the last of them; J10.

    ``pages``: ``keys``, node, parent (the master a page or master is based on).
    """
    both = lambda a, b: F.struct((a.n + b.n).alias("n"), b.base.alias("base"))
    chain = closure.folded(pages, F.struct(F.lit(1).cast("long").alias("n"), F.col("node").alias("base")), both, "_chain", keys)
    return chain.select(*keys, "node", (F.col("_chain.n") - 1).alias("masters"), F.col("_chain.base").alias("base"))


def bounds(rows: DataFrame, keys: list[str], top: Column, left: Column, bottom: Column, right: Column) -> DataFrame:
    """``keys`` and the box around the boxes of a group; A2, A3."""
    return rows.groupBy(*keys).agg(F.min(top).alias("top"), F.min(left).alias("left"), F.max(bottom).alias("bottom"), F.max(right).alias("right"))


def cell_place(name: Column) -> Column:
    """A cell's column and row number, of a name like 2:5; J17."""
    part = lambda i: F.split_part(name, F.lit(":"), F.lit(i)).cast("int")
    return F.struct(part(1).alias("col_no"), part(2).alias("row_no"))


def frame_stories(frames: DataFrame, items: DataFrame, on: dict[str, str], order: str) -> DataFrame:
    """``frames`` with items and last_item of the story that each holds; J11."""
    (story,) = on.values()
    per = items.groupBy(story).agg(F.count("*").alias("items"), F.max(order).alias("last_item"))
    return lookup.looked_up(frames, per, on, {"items": 0, "last_item": None})
