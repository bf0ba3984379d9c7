"""Ordered rows in groups: islands, counters, splits and neighbours, all as window functions.

Each takes the group's key columns and its order; a group is one document's rows, so no
window spans the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Delimiters of nested styles by name; of the units, each match is one.
DELIMITERS = {
    "AnyCharacter": r".", "AnyWord": r"\s*\S+", "Sentence": r"\s*[^.!?]*[.!?]+", "Digits": r"\d", "Letters": r"\p{L}", "Tabs": "\t", "ForcedLineBreak": "\u2028",
    "EmSpace": "\u2003", "EnSpace": "\u2002", "NonbreakingSpace": "\u00a0", "EndNestedStyle": "\u0003", "IndentHereTab": "\u0007", "InlineGraphic": "\ufffc",
}
UNITS = ("AnyCharacter", "AnyWord", "Sentence")


def _window(keys: list[str], order: list):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(rows: DataFrame, keys: list[str], order: list, same: Column, name: str = "island") -> DataFrame:
    """Numbers runs of neighbouring rows with equal ``same``, from 1 in each group."""
    w = _window(keys, order)
    changed = F.when(F.lag(same).over(w).eqNullSafe(same) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w)).drop("_changed")


def merged(rows: DataFrame, keys: list[str], order: list, style: Column, text: Column, alone: Column | None = None) -> DataFrame:
    """Neighbouring runs of one style as one run with their texts joined; ``alone`` rows never join; W4."""
    w = _window(keys, order)
    alone = F.lit(False) if alone is None else alone
    rows = rows.withColumns({"_style": style, "_text": text, "_alone": alone, "_n": F.row_number().over(w)})
    joins = F.lag("_style").over(w).eqNullSafe(F.col("_style")) & ~F.col("_alone") & ~F.lag("_alone").over(w)
    rows = rows.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    texts = F.array_sort(F.collect_list(F.struct("_n", "_text")))
    return rows.groupBy(*keys, "run").agg(F.first("_style").alias("style"), F.array_join(F.transform(texts, lambda s: s["_text"]), "").alias("text"))


def split_at(rows: DataFrame, keys: list[str], order: list, start: Column, name: str = "page") -> DataFrame:
    """A number that goes up at each row where ``start`` holds; rows before the first have 0; W6, W7."""
    return rows.withColumn(name, F.sum(start.cast("int")).over(_window(keys, order)))


def list_numbers(rows: DataFrame, keys: list[str], order: list, restart: Column, first: Column) -> DataFrame:
    """Numbers list items from ``first`` of the row that restarts the list; W1."""
    rows = split_at(rows.withColumn("_first", first), keys, order, restart, "_list")
    inner = _window([*keys, "_list"], order)
    return rows.withColumn("number", F.row_number().over(inner) - 1 + F.when(F.col("_list") == 0, 1).otherwise(F.first("_first").over(inner))).drop("_first", "_list")


def section_numbers(rows: DataFrame, keys: list[str], order: list, level: Column) -> DataFrame:
    """``g.n`` for rows of level 1 and ``g.n.m`` for deeper ones, the group g being rows of level 0; W2."""
    rows = rows.withColumn("_level", level)
    w = _window(keys, order)
    rows = rows.withColumn("_g", F.sum((F.col("_level") == 0).cast("int")).over(w))
    rows = rows.withColumn("_n", F.sum((F.col("_level") == 1).cast("int")).over(_window([*keys, "_g"], order)))
    rows = rows.withColumn("_m", F.sum((F.col("_level") > 1).cast("int")).over(_window([*keys, "_g", "_n"], order)))
    number = F.concat_ws(".", "_g", F.when(F.col("_level") > 0, F.col("_n")), F.when(F.col("_level") > 1, F.col("_m")))
    return rows.withColumn("section", number).drop("_level", "_g", "_n", "_m")


def row_roles(rows: DataFrame, keys: list[str], order: list, headers: int, footers: int) -> DataFrame:
    """Header, body or footer by row number, and whether a row opens or closes its part; W8."""
    w, all_ = _window(keys, order), Window.partitionBy(*keys)
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(all_))
    rows = rows.withColumn("role", F.when(F.col("_n") <= headers, "header").when(F.col("_n") > F.col("_all") - footers, "footer").otherwise("body"))
    part = Window.partitionBy(*keys, "role")
    return rows.withColumn("opens", F.col("_n") == F.min("_n").over(part)).withColumn("closes", F.col("_n") == F.max("_n").over(part)).drop("_n", "_all")


def banding(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows in turn of the even and the odd band, the first and last marked; W10."""
    w = _window(keys, order)
    down = Window.partitionBy(*keys).orderBy(*(F.desc(o) if isinstance(o, str) else o.desc() for o in order))
    n = F.row_number().over(w)
    return rows.withColumn("band", F.when(n == 1, "firstRow").when(F.row_number().over(down) == 1, "lastRow").when((n - 1) % 2 == 0, "band2Horz").otherwise("band1Horz"))


def tab_widths(rows: DataFrame, keys: list[str], order: list, position: str) -> DataFrame:
    """The distance from the stop before, and the stop after; W11."""
    w = _window(keys, order)
    return rows.withColumn("width", F.col(position) - F.coalesce(F.lag(position).over(w), F.lit(0.0))).withColumn("next_stop", F.lead(position).over(w))


def numbered(rows: DataFrame, keys: list[str], order: list, name: str, start: int = 1) -> DataFrame:
    """A running number from ``start``: z-order, ids, images and pages; W13-W17."""
    return rows.withColumn(name, F.row_number().over(_window(keys, order)) - 1 + start)


def depth(tokens: DataFrame, keys: list[str], order: list, opens: Column, closes: Column) -> DataFrame:
    """How many tags are open after each token; W9."""
    return tokens.withColumn("depth", F.sum(opens.cast("int") - closes.cast("int")).over(_window(keys, order)))


def until_nth(text: Column, delimiter: str, n: int, inclusive: bool = True) -> Column:
    """The part of a text that a nested style covers: up to its ``n``-th ``delimiter``, or all of it where there are fewer; W12.

    ``delimiter`` is a character or one of the names in ``DELIMITERS``. Words and sentences end before what separates them.
    """
    pattern = DELIMITERS.get(delimiter) or "".join(f"\\u{ord(c):04x}" for c in delimiter)
    unit = rf"(?s)^(?:{pattern}){{{n}}}" if delimiter in UNITS else rf"(?s)^(?:.*?{pattern}){{{n}}}"
    held = F.regexp_extract(text, unit, 0)
    if not inclusive and delimiter not in UNITS:
        held = F.regexp_replace(held, rf"(?s){pattern}$", "")
    return F.when(text.rlike(unit), held).otherwise(text)


def nested_styles(text: Column, rules: list[tuple[str, str, int, bool]]) -> Column:
    """(style, text) of each part of a paragraph: rules (style, delimiter, n, inclusive) take parts in turn, the rest has no style; W12."""
    parts, rest = [], text
    for style, delimiter, n, inclusive in rules:
        part = until_nth(rest, delimiter, n, inclusive)
        parts.append(F.struct(F.lit(style).alias("style"), part.alias("text")))
        rest = F.substr(rest, F.length(part) + 1)
    parts.append(F.struct(F.lit(None).cast("string").alias("style"), rest.alias("text")))
    return F.filter(F.array(*parts), lambda p: p.text != "")


def slice_of_stack(rows: DataFrame, keys: list[str], order: str, name: str, start: int, n: int) -> DataFrame:
    """``keys`` and parents: ``n`` names of an ordered stack from place ``start`` (from 1); O8."""
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n")))), lambda s: s.n)
    return rows.groupBy(*keys).agg(F.slice(names, start, n).alias("parents"))
