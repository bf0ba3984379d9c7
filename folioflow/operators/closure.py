"""Closures over the parent pointers of trees, by doubling.

``nodes`` have the key columns of their document, ``node`` (unique in it) and ``parent``. After the
k-th join each row has what lies 2^k generations above it, so a chain of n takes log n joins, however
deep; each round is written, so no plan holds the ones before it. A parent that isn't there ends a
chain, as does a node that names itself; a longer cycle is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.storage import discard, spread, written


def _parent() -> Column:
    return F.when(F.col("parent") != F.col("node"), F.col("parent"))


def _pointers(nodes: DataFrame, keys: list[str], *more: Column):
    have = written(spread(nodes.select(*keys, "node", _parent().alias("_up"), *more), *keys, "node"))
    return have, math.ceil(math.log2(have.count() + 1)) + 1


def _rounds(have: DataFrame, most: int):
    """Whether a pointer is left to follow; after more than ``most`` rounds that is a cycle."""
    if have.where(F.col("_up").isNotNull()).isEmpty():
        return False
    if most < 0:
        raise ValueError("the parents of some nodes form a cycle")
    return True


def folded(nodes: DataFrame, value: Column, both: Callable[[Column, Column], Column], name: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys``, node and ``name``: the ``value`` of each node and of all its ancestors, put together by ``both(nearer, farther)``.

    ``both`` must be associative.
    """
    have, most = _pointers(nodes, keys, value.alias("_value"))
    while _rounds(have, most):
        up = have.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("node").alias("_node"), F.col("_up").alias("_above"), F.col("_value").alias("_more"))
        on = have["_up"] == up["_node"]
        for k in keys:
            on = on & have[k].eqNullSafe(up[f"_{k}"])
        value = F.when(F.col("_node").isNull(), F.col("_value")).otherwise(both(F.col("_value"), F.col("_more")))
        next_ = written(have.join(up, on, "left").select(*keys, "node", F.col("_above").alias("_up"), value.alias("_value")))
        discard(have)
        have, most = next_, most - 1
    return have.select(*keys, "node", F.col("_value").alias(name))


def above(nodes: DataFrame, value: Column, both: Callable[[Column, Column], Column], name: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """As ``folded``, without the node's own value; null for a root."""
    whole = folded(nodes, value, both, name, keys).withColumnRenamed("node", "parent")
    return nodes.select(*keys, "node", _parent().alias("parent")).join(whole, [*keys, "parent"], "left").select(*keys, "node", name)


def with_descendant(nodes: DataFrame, hit: Column, name: str = "has", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys``, node and ``name``: whether a node below each node is a ``hit``; A17."""
    # a struct of the keys joins nulls with nulls, as in ``folded``
    nodes = nodes.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("none")))
    have, most = _pointers(nodes, ["_key"])
    marks = written(nodes.where(hit).where(_parent().isNotNull()).select("_key", F.col("parent").alias("node")).distinct())
    while _rounds(have, most):
        more = marks.join(have, ["_key", "node"]).where(F.col("_up").isNotNull()).select("_key", F.col("_up").alias("node"))
        next_marks = written(marks.union(more).distinct())
        up = have.select("_key", F.col("node").alias("_up"), F.col("_up").alias("_above"))
        next_ = written(have.join(up, ["_key", "_up"], "left").select("_key", "node", F.col("_above").alias("_up")))
        discard(have, marks)
        have, marks, most = next_, next_marks, most - 1
    return nodes.select(*keys, "_key", "node").join(marks.withColumn(name, F.lit(True)), ["_key", "node"], "left").select(*keys, "node", F.coalesce(name, F.lit(False)).alias(name))
