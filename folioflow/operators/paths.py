"""Subtrees as maps of paths to values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.filters import parsable
from folioflow.sources.xml import owned
from folioflow.storage import written

FILE = ("path", "member")


def path_entries(tree: DataFrame, root: Column, keys: tuple[str, ...] = FILE) -> DataFrame:
    """``keys``, root (a node), kind (its tag), ord, key, value: what each root's element and the elements below it say; S31.

    An attribute of the root is its name, that of an element below ``a::b->name``, and an element ``a::b``, with its whole
    text. The second and later children of one name in one element are ``b2``, ``b3``, as is a root's child with the name of an
    attribute. Page elements, and all below them, are other nodes' business. ``tree`` has all texts.

    A node's ancestors are the last nodes of each lower depth before it in preorder, so one window gives the whole path.
    """
    inside = owned(owned(tree, root, "root", keys), parsable(F.col("tag")) & ~root, "page_element", keys).where("root is not null and page_element is null")
    own = F.try_element_at("attrs", F.col("tag"))
    level = F.col("depth") - F.col("top_depth")
    per_root = Window.partitionBy(*keys, "root")
    same = Window.partitionBy(*keys, "parent_id", "tag").orderBy("node_id")
    rows = inside.withColumn("top_depth", F.min("depth").over(per_root)).withColumn("top_attrs", F.first(F.when(F.col("node_id") == F.col("root"), F.col("attrs")), ignorenulls=True).over(per_root)).withColumn("kind", F.first(F.when(F.col("node_id") == F.col("root"), F.col("tag")), ignorenulls=True).over(per_root))
    taken = (F.col("parent_id") == F.col("root")) & F.coalesce(F.map_contains_key("top_attrs", F.col("tag")), F.lit(False))
    nth = F.row_number().over(same) + F.when(taken, 1).otherwise(0)
    rows = rows.withColumn("level", level).withColumn("step", F.concat("tag", F.when(nth > 1, nth.cast("string")).otherwise("")))
    rows = written(rows.select(*keys, "root", "kind", "node_id", "level", "step", "attrs", "content"))
    deepest = rows.agg(F.max("level")).first()[0] or 0
    before = per_root.orderBy("node_id")
    steps = F.array(*(F.last(F.when(F.col("level") == d, F.col("step")), ignorenulls=True).over(before) for d in range(1, deepest + 1)))
    rows = rows.withColumn("at", F.array_join(F.slice(steps, 1, F.col("level")), "::") if deepest else F.lit(""))
    attrs = F.transform(F.map_entries("attrs"), lambda e, i: F.struct((i + 1).alias("i"), F.when(F.col("level") == 0, e.key).otherwise(F.concat("at", F.lit("->"), e.key)).alias("key"), e.value.alias("value")))
    element = F.when(F.col("level") > 0, F.array(F.struct(F.lit(0).alias("i"), F.col("at").alias("key"), F.coalesce("content", F.lit("")).alias("value")))).otherwise(F.array().cast("array<struct<i: int, key: string, value: string>>"))
    entries = rows.select(*keys, "root", "kind", "node_id", F.inline(F.concat(element, attrs)))
    return entries.select(*keys, "root", "kind", F.struct("node_id", "i").alias("ord"), "key", "value")


def path_maps(entries: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """``keys``, root, kind, props: the entries of each root as a map in document order; of two values of one key the last counts; S31."""
    once = entries.groupBy(*keys, "root", "kind", "key").agg(F.min("ord").alias("ord"), F.max_by("value", "ord").alias("value"))
    held = F.array_sort(F.collect_list(F.struct("ord", "key", "value")))
    return once.groupBy(*keys, "root", "kind").agg(F.map_from_entries(F.transform(held, lambda e: F.struct(e.key, e.value))).alias("props"))
