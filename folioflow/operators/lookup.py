"""Lookups between the tables of a book: first matches, defaults, fallback chains, and membership.

The reference walks lists to find an entry; here each lookup is an equality join, on the key columns of
the book and of the entry. What must be unique is made so before the join, so no lookup adds rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _struct(columns: list[str]) -> Column:
    return F.struct(*(F.col(c) for c in columns))


def first_of(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], match: Column | None = None) -> DataFrame:
    """``keys`` and ``columns`` of the first row of each group for which ``match`` holds; a group without one has nulls; O4, A9, F9, J25."""
    held = _struct(columns) if match is None else F.when(match, _struct(columns))
    by = _struct(order) if match is None else F.when(match, _struct(order))
    return rows.groupBy(*keys).agg(F.min_by(held, by).alias("_")).select(*keys, *(F.col(f"_.{c}").alias(c) for c in columns))


def last_of(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], match: Column | None = None) -> DataFrame:
    """As ``first_of``, of the last row; O5, J6."""
    held = _struct(columns) if match is None else F.when(match, _struct(columns))
    by = _struct(order) if match is None else F.when(match, _struct(order))
    return rows.groupBy(*keys).agg(F.max_by(held, by).alias("_")).select(*keys, *(F.col(f"_.{c}").alias(c) for c in columns))


def looked_up(rows: DataFrame, table: DataFrame, on: dict[str, str], columns: dict[str, object], inner: bool = False) -> DataFrame:
    """``rows`` with ``columns`` of the entry of ``table`` that ``on`` (row's column to table's) names, or each column's default; J1, J7, J9, J11, J15, J18, J20, J21, J26.

    An entry's key is unique in ``table``. Rows without an entry are left out if ``inner``.
    """
    entry = table.select(*(F.col(t).alias(f"_k{i}") for i, t in enumerate(on.values())), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)))
    same = reduce(lambda a, b: a & b, (F.col(r) == F.col(f"_k{i}") for i, r in enumerate(on)))
    value = lambda i, default: F.col(f"_v{i}") if default is None else F.coalesce(F.col(f"_v{i}"), default if isinstance(default, Column) else F.lit(default))
    out = rows.join(entry, same, "inner" if inner else "left")
    return out.select(*rows.columns, *(value(i, d).alias(c) for i, (c, d) in enumerate(columns.items())))


def first_found(rows: DataFrame, probes: list[tuple[DataFrame, str, str, str]], name: str, default=None) -> DataFrame:
    """``rows`` with ``name``: the value of the first of several tables that has an entry; J8, J22, J24.

    A probe is (table, its key, its value, the row's key); a null key of a row finds nothing.
    """
    out, found = rows, []
    for i, (table, key, value, own) in enumerate(probes):
        entry = table.select(F.col(key).alias(f"_key{i}"), F.col(value).alias(f"_found{i}"))
        out = out.join(entry, F.col(own) == F.col(f"_key{i}"), "left")
        found.append(F.col(f"_found{i}"))
    return out.select(*rows.columns, F.coalesce(*found, F.lit(default)).alias(name))


def containing(rows: DataFrame, table: DataFrame, keys: list[str], part: str, whole: str, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the first entry of the same ``keys`` whose ``whole`` has the row's ``part`` in it; nulls where none has; J2.

    The join is on ``keys``: a book has few fonts and few rules. ``rows`` are unique by ``keys`` and ``part``.
    """
    hits = rows.select(*keys, part).join(table.select(*keys, F.col(whole).alias("_whole"), *(F.col(c).alias(f"_{c}") for c in {*order, *columns})), keys)
    first = first_of(hits.where(F.contains("_whole", F.col(part))), [*keys, part], [f"_{c}" for c in order], [f"_{c}" for c in columns])
    return rows.join(first, [*keys, part], "left").select(*rows.columns, *(F.col(f"_{c}").alias(c) for c in columns))


def without(rows: DataFrame, table: DataFrame, on: dict[str, str]) -> DataFrame:
    """The rows that ``table`` doesn't name: hidden elements, overridden master items, unused entries; J12, J13, O7."""
    return _member(rows, table, on, "left_anti")


def named_in(rows: DataFrame, table: DataFrame, on: dict[str, str]) -> DataFrame:
    """The rows that ``table`` names; O7, F16."""
    return _member(rows, table, on, "left_semi")


def _member(rows: DataFrame, table: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    entry = table.select(*(F.col(t).alias(f"_k{i}") for i, t in enumerate(on.values())))
    return rows.join(entry, reduce(lambda a, b: a & b, (F.col(r) == F.col(f"_k{i}") for i, r in enumerate(on))), how)


def marked(rows: DataFrame, table: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """``rows`` with ``name``: whether ``table`` names the row; F16."""
    entry = table.select(*on.values()).distinct().withColumn("_there", F.lit(True))
    return looked_up(rows, entry, on, {"_there": False}).withColumnRenamed("_there", name)


def gathered(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """``keys`` and ``name``: the values of a repeated key as one array, in order; A13."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(held, lambda s: s.v).alias(name))


def child_counts(nodes: DataFrame, keys: list[str], tag: str, tags: dict[str, str]) -> DataFrame:
    """``keys``, a count of the children of each of ``tags`` (tag to name) and of all children; A15."""
    return nodes.groupBy(*keys).agg(*(F.count_if(F.col(tag) == t).alias(n) for t, n in tags.items()), F.count("*").alias("children"))


def page_totals(pages: DataFrame, sources: DataFrame, on: dict[str, str], keys: list[str]) -> DataFrame:
    """``keys`` and pages: the pages of all sources of a book, counted by source before sources are looked up; A1."""
    per = pages.groupBy(*on).agg(F.count("*").alias("_n"))
    return looked_up(per, sources, on, dict.fromkeys(keys), inner=True).groupBy(*keys).agg(F.sum("_n").alias("pages"))


def present(rows: DataFrame, keys: list[str], full: Column) -> DataFrame:
    """``keys`` of the groups with a row that isn't empty: pages with content; F8."""
    return rows.groupBy(*keys).agg(F.bool_or(F.coalesce(full, F.lit(False))).alias("_full")).where("_full").select(*keys)


def counted_first(rows: DataFrame, keys: list[str], node: str) -> DataFrame:
    """``keys``, the least ``node`` and uses of each group: nodes found again by their hash; J25."""
    return rows.groupBy(*keys).agg(F.min(node).alias(node), F.count("*").alias("uses"))
