"""Spreads of layout packages: their pages, the items on them, and the items that pages take from their masters.

All functions read ``spread_nodes``, which parses each member once. A spread is a ``Spread`` or ``MasterSpread`` with a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry
from folioflow.operators import closure, layout
from folioflow.sources.xml import _attrs, nodes, tagged
from folioflow.storage import discard, written

KEYS = ["path", "member"]
# The tags of items on a spread.
ITEMS = ("Rectangle", "TextFrame", "Group", "Polygon", "Oval", "GraphicLine")


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def spread_nodes(members: DataFrame) -> DataFrame:
    """The nodes inside each spread and master spread of packages, with spread_node and spread (its name), as a written table."""
    named = lambda e: (tagged("Spread")(e) or tagged("MasterSpread")(e)) and "Self" in _attrs(e)
    inside = nodes(members.where(F.col("member").rlike(r"^(Master)?Spreads/.*\.xml$")), owners={"spread_node": named}).where("spread_node is not null")
    name = F.first(F.when(F.col("node_id") == F.col("spread_node"), _attr("Self")), ignorenulls=True).over(Window.partitionBy(*KEYS, "spread_node"))
    return written(inside.select(*KEYS, "node_id", "parent_id", "depth", "last", "tag", "attrs", "spread_node", name.alias("spread")))


def _numbers(text: Column, n: int) -> list[Column]:
    v = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")
    return [F.coalesce(F.get(v, F.lit(i)).try_cast("double"), F.lit(0.0)) for i in range(n)]


def _matrix(text: Column) -> Column:
    return geometry.matrix(F.coalesce(text, F.lit("")))


def pages(tree: DataFrame) -> DataFrame:
    """path, spread, is_master, page, ord, pages (of its spread), name, side, master (a spread, or null), overrides, transform and box (on the spread) of each page; S23.

    A page left of the spread's origin is a left one.
    """
    m, b = _matrix(_attr("ItemTransform")), _numbers(_attr("GeometricBounds"), 4)
    rows = tree.where("tag = 'Page'").select(
        "path", "member", "spread", F.startswith("member", F.lit("Master")).alias("is_master"), _attr("Self").alias("page"), F.col("node_id").alias("ord"), _attr("Name").alias("name"), F.nullif(_attr("AppliedMaster"), F.lit("n")).alias("master"),
        F.filter(F.split(F.coalesce(_attr("OverrideList"), F.lit("")), " "), lambda x: x != "").alias("overrides"), m.alias("transform"), geometry.transformed(geometry.box(*b), m).alias("box"),
    )
    n = F.count("*").over(Window.partitionBy("path", "spread"))
    return rows.select("path", "spread", "is_master", "page", "ord", n.alias("pages"), "name", F.when(F.col("transform.tx") < 0, "left").otherwise("right").alias("side"), "master", "overrides", "transform", "box")


def composed(near: Column, far: Column) -> Column:
    """The matrix that applies ``near`` and then ``far``; C20, C23."""
    x = lambda px, py: far.a * px + far.c * py
    y = lambda px, py: far.b * px + far.d * py
    return F.struct(
        x(near.a, near.b).alias("a"), y(near.a, near.b).alias("b"), x(near.c, near.d).alias("c"), y(near.c, near.d).alias("d"),
        (x(near.tx, near.ty) + far.tx).alias("tx"), (y(near.tx, near.ty) + far.ty).alias("ty"),
    )


def _boxes(tree: DataFrame) -> DataFrame:
    """path, member, node and box of each item with a path: the bounds of its anchors, in its own coordinates; A2."""
    w = Window.partitionBy(*KEYS).orderBy("node_id")
    # an item's path lies in its own Properties, which hold no items: the last one opened before a point
    own = F.last(F.when(F.col("tag") == "Properties", F.struct("last", "parent_id")), ignorenulls=True).over(w)
    points = tree.withColumn("own", own).where("tag = 'PathPointType' and node_id <= own.last")
    x, y = _numbers(_attr("Anchor"), 2)
    rows = points.groupBy(*KEYS, F.col("own.parent_id").alias("node")).agg(F.min(y).alias("top"), F.min(x).alias("left"), F.max(y).alias("bottom"), F.max(x).alias("right"))
    return rows.select(*KEYS, "node", F.struct("top", "left", "bottom", "right").alias("box"))


def items(tree: DataFrame) -> DataFrame:
    """path, member, spread, node, parent (an item, or null), level (0 on the spread), item (its name), tag, story (of a frame), layer, visible, transform, world and box of each item; S23.

    Items lie directly on a spread or in another item. ``world`` is the composition of the transforms up to the spread.
    A box is in the item's own coordinates; a group's is that around its members, level by level from the inside; A3.
    """
    found = tree.where(F.col("tag").isin(*ITEMS))
    found = found.select(*KEYS, "spread", F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), "depth", "spread_node", _attr("Self").alias("item"), "tag", _attr("ParentStory").alias("story"), _attr("ItemLayer").alias("layer"), (F.lower(F.coalesce(_attr("Visible"), F.lit("true"))) == "true").alias("visible"), _matrix(_attr("ItemTransform")).alias("transform"))
    up = found.select(*KEYS, F.col("node").alias("parent"), F.lit(True).alias("nested"))
    found = found.join(up, [*KEYS, "parent"], "left").where("nested or parent = spread_node")
    top = tree.where("node_id = spread_node").select(*KEYS, "spread_node", F.col("depth").alias("top"))
    found = found.join(top, [*KEYS, "spread_node"]).withColumn("parent", F.when(F.col("nested"), F.col("parent"))).withColumn("level", F.col("depth") - F.col("top") - 1)
    rows = written(found.join(_boxes(tree), [*KEYS, "node"], "left").select(*KEYS, "spread", "node", "parent", "level", "item", "tag", "story", "layer", "visible", "transform", "box"))
    deepest = rows.agg(F.max("level")).first()[0] or 0
    for level in range(deepest - 1, -1, -1):
        part = rows.where(F.col("level") == level + 1).select(*KEYS, F.col("parent").alias("node"), geometry.transformed(F.col("box"), F.col("transform")).alias("b")).where("b.top is not null")
        around = layout.bounds(part, [*KEYS, "node"], F.col("b.top"), F.col("b.left"), F.col("b.bottom"), F.col("b.right"))
        around = around.select(*KEYS, "node", F.struct("top", "left", "bottom", "right").alias("around"))
        grouped = (F.col("level") == level) & (F.col("tag") == "Group")
        next_ = written(rows.join(around, [*KEYS, "node"], "left").withColumn("box", F.when(grouped, F.col("around")).otherwise(F.col("box"))).drop("around"))
        discard(rows)
        rows = next_
    world = closure.folded(rows, F.col("transform"), composed, "world", KEYS)
    return rows.join(world, [*KEYS, "node"])


def page_of_items(all_items: DataFrame, all_pages: DataFrame) -> DataFrame:
    """path, spread, member, node, item, tag, top (the item on the spread it is in), page (null on the pasteboard) of each visible item; J14.

    The first page that has the centre of an item that lies on the spread takes it, with all that is in it.
    """
    box = geometry.transformed(F.col("box"), F.col("transform"))
    top = all_items.where("level = 0 and visible").withColumn("at", geometry.size_and_center(box))
    placed = layout.pages_of(
        top.select(F.struct("path", "spread").alias("spread"), F.struct("member", "node").alias("element"), F.col("at.x").alias("x"), F.col("at.y").alias("y")),
        all_pages.select(F.struct("path", "spread").alias("spread"), "page", "ord", "box.top", "box.left", "box.bottom", "box.right"),
    )
    placed = placed.select(F.col("spread.path").alias("path"), F.col("element.member").alias("member"), F.col("element.node").alias("top_node"), "page")
    # the item on the spread that holds each item
    roots = closure.folded(all_items, F.struct("node", "item", "visible"), lambda near, far: F.struct(far.node.alias("node"), far.item.alias("item"), (near.visible & far.visible).alias("visible")), "_root", KEYS)
    rows = all_items.join(roots, [*KEYS, "node"]).where("_root.visible").select(*KEYS, "spread", "node", "item", "tag", F.col("_root.node").alias("top_node"), F.col("_root.item").alias("top"))
    return rows.join(placed, [*KEYS, "top_node"], "left").select("path", "spread", "member", "node", "item", "tag", "top", "page")


def page_items(all_pages: DataFrame, placed: DataFrame) -> DataFrame:
    """path, page, level, ord, item, tag: what each page shows, its masters' items first, those of the last master before all; J10, J13, F24.

    A page's master is the page of its master spread on the same side, or the only one there; masters have masters. Each page leaves out those of its
    own master's items that it overrides. ``level``: 0 for own items, 1 for those of the master. Only items that lie on a spread count; what is in them comes with them.
    """
    up = all_pages.select("path", F.col("spread").alias("master"), F.col("page").alias("up"), F.col("ord").alias("up_ord"), F.col("side").alias("up_side"), F.col("pages").alias("n"))
    links = all_pages.select("path", "page", "side", "master").join(up, ["path", "master"]).where("n = 1 or side = up_side")
    links = links.groupBy("path", "page").agg(F.min_by("up", "up_ord").alias("parent"))
    own = all_pages.select("path", F.col("page").alias("node"), "overrides", "is_master").join(links.withColumnRenamed("page", "node"), ["path", "node"], "left")
    step = F.array(F.struct(F.col("node").alias("page"), "overrides"))
    chain = closure.folded(own, step, F.concat, "chain", ["path"]).join(own.where("not is_master").select("path", "node"), ["path", "node"])
    below = F.transform("chain", lambda s, i: F.struct(i.alias("level"), s.page.alias("of"), F.when(i > 0, F.get(F.col("chain"), i - 1).overrides).otherwise(F.array().cast("array<string>")).alias("hidden")))
    taken = chain.select("path", F.col("node").alias("page"), F.inline(below))
    lying = placed.where("item <=> top and page is not null").select("path", F.col("page").alias("of"), F.col("node").alias("ord"), "item", "tag")
    return taken.join(lying, ["path", "of"]).where("item is null or not array_contains(hidden, item)").select("path", "page", "level", "ord", "item", "tag")
