"""Styles: inheritance, signatures, and merging of property maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import closure, lookup


def merged(over: Column, under: Column) -> Column:
    """Two maps' union in which ``over`` wins; A11, C40."""
    return F.map_concat(over, F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k)))


def signature(props: Column) -> Column:
    """A hash of a map's entries by name, empty values left out; A4, O3."""
    kept = F.filter(F.array_sort(F.map_entries(props)), lambda e: F.coalesce(e.value, F.lit("")) != "")
    return F.md5(F.array_join(F.transform(kept, lambda e: F.concat(e.key, F.lit(":"), e.value)), ";").cast("binary"))


def deduplicated(rows: DataFrame, keys: list[str], order: list[str], sig: str, prefix: str = "cls_") -> DataFrame:
    """One row for each signature of a group, named by when it was first seen; A4, A5."""
    first = rows.groupBy(*keys, sig).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("uses"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1
    return first.withColumn("name", F.concat(F.lit(prefix), n.cast("string")))


def flattened(styles: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys``, style, props: each style's own and inherited properties, the nearest winning; A12.

    ``styles``: ``keys``, style, based_on, props. A chain may be of any length; one that comes back to itself is an error.
    """
    nodes = styles.withColumnsRenamed({"style": "node", "based_on": "parent"})
    return closure.folded(nodes, F.col("props"), merged, "props", keys).withColumnRenamed("node", "style")


def ancestry(nodes: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys``, node, styles: the applied styles from each node to its root, the node's own first; D37.

    ``nodes``: ``keys``, node, parent, style (null for none).
    """
    return closure.folded(nodes, F.array_compact(F.array("style")), F.concat, "styles", keys)


def sorted_signature(entries: Column) -> Column:
    """A hash of declarations in the order of their text; O3."""
    return F.md5(F.concat_ws(";", F.array_sort(entries)).cast("binary"))


def united(*lists: Column) -> Column:
    """The attributes' words of several lists as one, in order; A20."""
    return F.array_join(F.flatten(F.array(*(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "") for x in lists))), " ")


def rule_union(*tables: DataFrame) -> DataFrame:
    """The rules of all tables, by name of their columns; O6."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def used_names(rows: DataFrame, keys: list[str], *applied: Column) -> DataFrame:
    """``keys`` and used: the names that rows of a group apply, each once, the first of ``applied`` that a row has; A21."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.coalesce(*applied))), " ").alias("used"))


def page_sheets(used: DataFrame, declared: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys`` and css: the declared names that each page uses, each once; A7."""
    rows = lookup.named_in(used.select(*keys, name).distinct(), declared, {name: name})
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(name)), " ").alias("css"))


def digest(*names: str) -> Column:
    """A hash of several columns of a node; J25."""
    return F.md5(F.concat_ws(".", *names).cast("binary"))
