"""Markup out of rows: trees, paragraphs, tables, shapes and fragments.

Each works on the rows of one document, table or paragraph, so what is collected together is
one output text and no group spans the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import attributes
from folioflow.operators import runs


def _joined(order: Column, text: Column, between: str = "") -> Column:
    """An aggregate: ``text`` of the group's rows in ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda s: s.t), between)


def serialized(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and html of each tree of ``nodes``: pre, depth, tag (null for a text alone), attrs (a map) and text in document order; K9.

    A node's end tag comes before the next node that isn't deeper, deeper nodes' first. That node is found for all
    depths at once, by a window for each depth over the nodes at or above it, so the work is linear in nodes times depths.
    """
    deepest = F.max("depth").over(Window.partitionBy(*keys))
    levels = nodes.select(*keys, "pre", "depth", "tag", deepest.alias("_deepest")).withColumn("_level", F.explode(F.sequence("depth", "_deepest")))
    after = F.lead("pre").over(Window.partitionBy(*keys, "_level").orderBy("pre"))
    ends = levels.withColumn("_after", after).where(F.col("_level") == F.col("depth"))
    token = lambda at, rank, depth, text: F.struct(at.cast("long").alias("o"), F.lit(rank).alias("r"), depth.cast("int").alias("d"), text.alias("t")).alias("_token")
    ends = ends.where("tag is not null").select(*keys, token(F.coalesce("_after", F.lit((1 << 63) - 1)), 0, -F.col("depth"), F.concat(F.lit("</"), F.col("tag"), F.lit(">"))))
    attrs = attributes(F.col("attrs"))
    opening = F.concat(F.coalesce(F.concat(F.lit("<"), F.col("tag"), F.when(attrs != "", F.concat(F.lit(" "), attrs)).otherwise(""), F.lit(">")), F.lit("")), F.coalesce("text", F.lit("")))
    starts = nodes.select(*keys, token(F.col("pre"), 1, F.lit(0), opening))
    return starts.union(ends).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_token")), lambda s: s.t), "").alias("html"))


def paragraphs(content: DataFrame, keys: list[str], order: list, is_break: Column, style: Column, text: Column) -> DataFrame:
    """``keys``, block and html: a division for each run of content up to a break, with a span for each row of content; P16.

    A block without content has a no-break space.
    """
    rows = content.withColumns({"_break": is_break, "_style": style, "_text": text})
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("block", F.coalesce(F.sum(F.col("_break").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.row_number().over(w))
    span = F.when(~F.col("_break"), F.concat(F.lit('<span class="'), F.col("_style"), F.lit('">'), F.col("_text"), F.lit("</span>")))
    return rows.groupBy(*keys, "block").agg(F.concat(F.lit("<div>"), F.coalesce(F.nullif(_joined(F.col("_n"), span), F.lit("")), F.lit("&#160;")), F.lit("</div>")).alias("html"))


def tables(cells: DataFrame, keys: list[str], headers: int, footers: int) -> DataFrame:
    """``keys`` and html of each table of ``cells``: row, col, rowspan, colspan, text and, if there is one, style; P9, P18.

    Cells of header rows are headings; spans are written where they are 0 or above 1. ``text`` is markup.
    """
    style = F.coalesce(F.concat(F.lit(' style="'), F.nullif("style", F.lit("")), F.lit('"')), F.lit("")) if "style" in cells.columns else F.lit("")
    nth = F.dense_rank().over(Window.partitionBy(*keys).orderBy("row"))
    rows = cells.withColumn("_n", nth).withColumn("_all", F.max("_n").over(Window.partitionBy(*keys)))
    role = F.when(F.col("_n") <= headers, "thead").when(F.col("_n") > F.col("_all") - footers, "tfoot").otherwise("tbody")
    tag = F.when(role == "thead", "th").otherwise("td")
    spans = [F.when((F.col(n) == 0) | (F.col(n) > 1), F.concat(F.lit(f' {n}="'), F.col(n).cast("string"), F.lit('"'))).otherwise("") for n in ("rowspan", "colspan")]
    cell = F.concat(F.lit("<"), tag, *spans, style, F.lit(">"), F.col("text"), F.lit("</"), tag, F.lit(">"))
    lines = rows.select(*keys, "row", "col", role.alias("part"), cell.alias("cell")).groupBy(*keys, "row", "part").agg(_joined(F.struct("col", "cell"), F.col("cell")).alias("cells"))
    edge = Window.partitionBy(*keys, "part")
    lines = lines.withColumns({"opens": F.col("row") == F.min("row").over(edge), "closes": F.col("row") == F.max("row").over(edge)})
    mark = lambda on, text: F.when(F.col(on), F.concat(F.lit(text), F.col("part"), F.lit(">"))).otherwise("")
    line = F.concat(mark("opens", "<"), F.lit("<tr>"), F.col("cells"), F.lit("</tr>"), mark("closes", "</"))
    return lines.groupBy(*keys).agg(F.concat(F.lit("<table>"), _joined(F.col("row"), line), F.lit("</table>")).alias("html"))


#: Levels of nested lists that the source format has.
LEVELS = 9


def nested_lists(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys``, start (the first item's ``order``) and html of each list of ``items``: level (from 0), tag (ul or ol) and html; W5, P8.

    An item lies in the nearest item before it that has a lower level, so its depth is the number of levels below its own
    that are still open there. Neighbours in one item make one list as long as their tags agree. All from windows: the last place of
    each level before an item tells which levels are open, the last tag at each depth what has to be closed.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("level", F.least(F.greatest(F.coalesce("level", F.lit(0)), F.lit(0)), F.lit(LEVELS - 1))).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumns({f"_at{k}": F.coalesce(F.max(F.when(F.col("level") == k, F.col("_n"))).over(before), F.lit(0)) for k in range(LEVELS)})
    # a lower level is open if it came after all that are lower still
    lower = lambda k: F.greatest(F.lit(0), F.lit(0), *(F.col(f"_at{j}") for j in range(k)))
    rows = rows.withColumn("_depth", sum((F.when((F.col("level") > k) & (F.col(f"_at{k}") > lower(k)), 1).otherwise(0) for k in range(LEVELS)), F.lit(0)))
    rows = rows.withColumns({f"_tag{d}": F.last(F.when(F.col("_depth") == d, F.col("tag")), ignorenulls=True).over(before) for d in range(LEVELS)} | {"_was": F.lag("_depth").over(w), "_next": F.lead("_depth").over(w)})
    ended = lambda d, tag: F.concat(F.lit("</li></"), tag, F.lit(">"))
    closing = [F.when((F.col("_was") >= d) & (F.col("_depth") < d), ended(d, F.col(f"_tag{d}"))).otherwise("") for d in range(LEVELS - 1, 0, -1)]
    sibling = F.coalesce(*(F.when(F.col("_depth") == d, F.col(f"_tag{d}")) for d in range(LEVELS)))
    opened = F.concat(F.lit("<"), F.col("tag"), F.lit(">"))
    begin = F.when(F.col("_was").isNull() | (F.col("_depth") > F.col("_was")), opened).when(sibling == F.col("tag"), F.lit("</li>")).otherwise(F.concat(ended(0, sibling), opened))
    # the last item closes all that is open: its own list and those around it
    around = [F.when(F.col("_next").isNull() & (F.col("_depth") >= d), ended(d, F.when(F.col("_depth") == d, F.col("tag")).otherwise(F.col(f"_tag{d}")))).otherwise("") for d in range(LEVELS - 1, -1, -1)]
    text = F.concat(*closing, begin, F.lit("<li>"), F.col("html"), *around)
    return rows.groupBy(*keys).agg(F.min(order).alias("start"), _joined(F.col(order), text).alias("html"))


def fragments(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ord, kind and fragment: text split at tabs, the tabs kept as rows of their own; P14."""
    parts = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("\t|[^\t]+"), F.lit(0)), lambda p: p != "")
    out = rows.select(*keys, F.posexplode(parts).alias("ord", "fragment"))
    return out.select(*keys, F.col("ord").cast("long").alias("ord"), F.when(F.col("fragment") == "\t", "tab").otherwise("text").alias("kind"), "fragment")


def shape(is_open: Column, path: Column, points: Column) -> Column:
    """A path if the shape is open, else a polygon; P19."""
    return F.when(is_open, F.concat(F.lit('<path d="'), path, F.lit('" />'))).otherwise(F.concat(F.lit('<polygon points="'), points, F.lit('" />')))


def image(source: Column, in_shape: Column) -> Column:
    """An image, or one inside a shape's drawing; P20."""
    name = F.replace(source, F.lit("&"), F.lit("&amp;"))
    return F.when(in_shape, F.concat(F.lit('<image xlink:href="'), name, F.lit('" />'))).otherwise(F.concat(F.lit('<img src="'), name, F.lit('" style="width:100%; height:100%;" />')))


def tab(width: Column) -> Column:
    """A span of the stop's width, or the tab itself where there is none; P21."""
    return F.coalesce(F.concat(F.lit('<span style="display:inline-block;width:'), F.round(width).cast("int").cast("string"), F.lit('px"></span>')), F.lit("\t"))


def anchor(key: Column, href: Column, text: Column) -> Column:
    """A link where there is a target, else the place that links lead to; P17."""
    return F.when(href.isNotNull(), F.concat(F.lit('<a href="'), href, F.lit('">'), text, F.lit("</a>"))).otherwise(F.concat(F.lit('<a id="Hyperlink_'), key, F.lit('">'), text, F.lit("</a>")))


def toc_row(number: Column, description: Column, page: Column, length: int = 140) -> Column:
    """A row of a contents table, its description filled up with dots; P11."""
    filled = F.when(F.length(description) < length, F.rpad(description, length, ".")).otherwise(description)
    return F.concat(F.lit("<tr><td>"), number, F.lit("</td><td>"), filled, F.lit("</td><td>"), page, F.lit("</td></tr>"))


def bound_frames(rows: DataFrame, keys: list[str], order: list, is_destination: Column, frame: Column) -> DataFrame:
    """Destinations with the frame that finishes next, null after the last one; ``frame`` is null where none finishes; J5."""
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumns({"_is": is_destination, "bound": F.first(frame, ignorenulls=True).over(ahead)}).where("_is").drop("_is")


def counters(items: DataFrame, keys: list[str], order: list, level: Column, levels: int = 3) -> DataFrame:
    """``number``: each level's counter since the last item of a level above, joined by dots; W3."""
    rows = items.withColumn("_level", level)
    held: list[str] = []
    for k in range(levels):
        inner = Window.partitionBy(*keys, *held).orderBy(*order)
        rows = rows.withColumn(f"_c{k}", F.sum((F.col("_level") == k).cast("int")).over(inner))
        held.append(f"_c{k}")
    parts = [F.when(F.col("_level") >= k, F.col(c).cast("string")) for k, c in enumerate(held)]
    return rows.withColumn("number", F.concat_ws(".", *parts)).drop("_level", *held)
