"""Word documents: paragraphs, runs, tables, styles and numbering from an archive's members.

``body`` parses each document once, with the paragraph, run, table and so on that each node is in, as a written
table; what reads a body takes it, or makes it from ``members``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import css as css_of
from folioflow.functions.word import cell_width
from folioflow.operators import closure, emit, lookup, runs
from folioflow.sources.xml import nodes, owned, tagged
from folioflow.storage import written

OWNERS = ("tbl", "tr", "tc", "p", "r", "hyperlink")


def document_nodes(members: DataFrame, owners: dict = {}) -> DataFrame:  # noqa: B006
    return nodes(members.where("member = 'word/document.xml'"), owners=owners)


def _drops(e) -> bool:
    """Whether an element is a drop-down control: its properties hold a list."""
    return any(tagged("sdtPr")(c) and any(tagged("dropDownList")(x) or tagged("comboBox")(x) for x in c) for c in e)


def body(members: DataFrame) -> DataFrame:
    """The nodes of each document, with the outermost table, row and cell, paragraph, run and link that each is in, and ``choice``, the drop-down control; P8."""
    if "hyperlink" in members.columns:
        return members
    tree = document_nodes(members, {**{name: tagged(name) for name in OWNERS}, "choice": _drops}).where("node_id is not null")
    return written(tree.select("path", "node_id", "parent_id", "depth", "last", "tag", "attrs", "text", *OWNERS, "choice"))


def paragraphs(members: DataFrame) -> DataFrame:
    """path, p (its node), style, num_id, level and text of each paragraph; F21."""
    tree = body(members).where("p is not null")
    value = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("attrs")["val"]))
    text = F.array_sort(F.collect_list(F.when(F.col("tag") == "t", F.struct("node_id", "text"))))
    out = tree.groupBy("path", "p").agg(value("pStyle").alias("style"), value("numId").cast("int").alias("num_id"), value("ilvl").cast("int").alias("level"), text.alias("t"))
    return out.select("path", "p", "style", "num_id", "level", F.array_join(F.transform("t", lambda s: s.text), "").alias("text"))


def lists(members: DataFrame) -> DataFrame:
    """path, list, level, items: neighbouring list paragraphs of one numbering; W5."""
    rows = runs.islands(paragraphs(members), ["path"], ["p"], F.col("num_id"), "list").where("num_id >= 1")
    return rows.groupBy("path", "list", "num_id").agg(F.count("*").alias("items"))


def _value(tag: str, key: str = "val") -> Column:
    """An aggregate over a node's subtree: the attribute of its first element of a tag, null for none."""
    at = F.col("tag") == tag
    return F.min_by(F.when(at, F.try_element_at("attrs", F.lit(key))), F.when(at, F.col("node_id")))


def _on(tag: str) -> Column:
    """An aggregate: whether there is an element of a tag that isn't switched off."""
    return F.coalesce(F.bool_or(F.when(F.col("tag") == tag, ~F.coalesce(F.try_element_at("attrs", F.lit("val")), F.lit("")).isin("0", "false", "none"))), F.lit(False))


def _declarations() -> Column:
    """An aggregate: the CSS of the run properties in a subtree; half points to points; C33."""
    size, color = F.floor(_value("sz").try_cast("double") / 2).cast("string"), _value("color")
    vertical = F.when(_value("vertAlign") == "superscript", "super").when(_value("vertAlign") == "subscript", "sub")
    parts = [
        F.concat(F.lit("font-family:"), _value("rFonts", "ascii")), F.concat(F.lit("color:#"), F.when(color == "auto", "000000").otherwise(color)), F.concat(F.lit("font-size:"), size, F.lit("pt")),
        F.when(_on("b"), "font-weight:bold"), F.when(_on("i"), "font-style:italic"), F.when(_on("u"), "text-decoration:underline"), F.when(_on("caps"), "text-transform:uppercase"), F.concat(F.lit("vertical-align:"), vertical),
    ]
    return F.concat_ws(";", *parts)


# Alignments of paragraphs.
ALIGNMENTS = {"center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "justify", "left": "left", "start": "left"}


def _paragraph_declarations() -> Column:
    """An aggregate: the CSS of the paragraph properties in a subtree; twips over 11 to pixels, an indent of 0 is the left indent; C33."""
    px = lambda v: F.concat(F.round(F.coalesce(v.try_cast("double"), F.lit(0.0)) / 11).cast("int").cast("string"), F.lit("px"))
    has = lambda tag: F.bool_or(F.col("tag") == tag)
    first = px(_value("ind", "firstLine"))
    indent = F.when(has("ind"), F.when(first == "0px", px(_value("ind", "left"))).otherwise(first))
    parts = [
        F.when(_value("spacing", "before").isNotNull(), F.concat(F.lit("margin-top:"), px(_value("spacing", "before")))), F.when(_value("spacing", "after").isNotNull(), F.concat(F.lit("margin-bottom:"), px(_value("spacing", "after")))),
        F.concat(F.lit("text-align:"), css_of.mapped(_value("jc"), ALIGNMENTS, F.lit(None).cast("string"))), F.concat(F.lit("text-indent:"), indent),
    ]
    return F.concat_ws(";", *parts)


def _escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def relations(members: DataFrame) -> DataFrame:
    """path, rel, target, type of each relationship of a document; K12."""
    links = nodes(members.where("member = 'word/_rels/document.xml.rels'")).where("tag = 'Relationship'")
    at = lambda name: F.try_element_at("attrs", F.lit(name))
    return links.groupBy("path", at("Id").alias("rel")).agg(F.min_by(at("Target"), "node_id").alias("target"), F.min_by(at("Type"), "node_id").alias("type"))


def links_of(tree: DataFrame, rels: DataFrame) -> DataFrame:
    """path, hyperlink, href of each link of a body: its relationship's target, or a place in the document."""
    at = lambda name: F.try_element_at("attrs", F.lit(name))
    rows = tree.where("tag = 'hyperlink' and node_id = hyperlink").select("path", "hyperlink", at("id").alias("rel"), at("anchor").alias("anchor"))
    rows = lookup.looked_up(rows, rels.select("path", "rel", "target"), {"path": "path", "rel": "rel"}, {"target": None})
    return rows.select("path", "hyperlink", F.concat(F.coalesce("target", F.lit("")), F.coalesce(F.concat(F.lit("#"), "anchor"), F.lit(""))).alias("href"))


def choices(tree: DataFrame) -> DataFrame:
    """path, choice, r (the run that shows it) and html of each drop-down control in a paragraph: its entries, the one that is shown selected; P10."""
    at = lambda name: F.try_element_at("attrs", F.lit(name))
    inside = tree.where("choice is not null and p is not null")
    shown = inside.where("r is not null").groupBy("path", "choice").agg(F.min("r").alias("r"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "t", F.struct("node_id", "text")))), lambda s: s.text), "").alias("shown"))
    entries = inside.where("tag = 'listItem'").select("path", "choice", "node_id", F.coalesce(at("displayText"), at("value"), F.lit("")).alias("name"), F.coalesce(at("value"), at("displayText"), F.lit("")).alias("value"))
    rows = shown.join(entries, ["path", "choice"], "left")
    option = F.concat(F.lit('<option value="'), _escaped(F.col("value")), F.lit('"'), F.when(F.col("name") == F.col("shown"), ' selected="selected"').otherwise(""), F.lit(">"), _escaped(F.col("name")), F.lit("</option>"))
    return rows.groupBy("path", "choice", "r").agg(F.concat(F.lit("<select>"), _joined("node_id", option), F.lit("</select>")).alias("html"))


def body_runs(members: DataFrame) -> DataFrame:
    """path, p, r, css, hyperlink and html of each run of the body's paragraphs: its texts, tabs and breaks in order; S13, C4.

    A drop-down control is shown by its first run alone.
    """
    tree = body(members)
    rows = tree.where("p is not null and r is not null")
    tag = F.col("tag")
    piece = F.when(tag == "t", _escaped(F.col("text"))).when(tag == "tab", "\t").when(tag == "br", F.when(F.try_element_at("attrs", F.lit("type")) == "page", "").otherwise("<br />"))
    held = F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("node_id", piece.alias("t")))))
    rows = rows.groupBy("path", "p", "r").agg(_declarations().alias("css"), F.first("hyperlink").alias("hyperlink"), F.first("choice").alias("choice"), F.array_join(F.transform(held, lambda s: s.t), "").alias("html"))
    drops = choices(tree).select("path", "choice", "r", F.col("html").alias("control"))
    rows = rows.join(drops, (rows["path"] == drops["path"]) & (rows["choice"] == drops["choice"]) & (rows["r"] == drops["r"]), "left").select(rows["path"], "p", rows["r"], "css", "hyperlink", rows["choice"], "html", "control")
    return rows.select("path", "p", "r", "css", "hyperlink", F.when(F.col("choice").isNull(), F.col("html")).otherwise(F.coalesce("control", F.lit(""))).alias("html"))


def body_paragraphs(members: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """path, p, tbl, tr, tc (the table, row and cell it is in, or null), style, num_id, level, breaks (whether a page starts in it) and html; P8.

    Neighbouring runs of one style and link become one span; text without a style has none.
    """
    tree = body(members) if tree is None else tree
    breaks = F.bool_or((F.col("tag") == "br") & (F.try_element_at("attrs", F.lit("type")) == "page"))
    props = tree.where("p is not null").groupBy("path", "p").agg(
        F.first("tbl").alias("tbl"), F.first("tr").alias("tr"), F.first("tc").alias("tc"), _value("pStyle").alias("style"), _value("numId").try_cast("int").alias("num_id"), _value("ilvl").try_cast("int").alias("level"),
        F.coalesce(breaks, F.lit(False)).alias("breaks"),
    )
    pieces = lookup.looked_up(body_runs(tree), links_of(tree, relations(members)), {"path": "path", "hyperlink": "hyperlink"}, {"href": None})
    # a run's style and its link decide which neighbours it joins
    merged = runs.merged(pieces, ["path", "p"], ["r"], F.struct("css", "href", "hyperlink"), F.col("html"))
    span = F.when(F.col("style.css") == "", F.col("text")).otherwise(F.concat(F.lit('<span style="'), "style.css", F.lit('">'), "text", F.lit("</span>")))
    span = F.when(F.coalesce("style.href", F.lit("")) == "", span).otherwise(F.concat(F.lit('<a href="'), _escaped(F.col("style.href")), F.lit('">'), span, F.lit("</a>")))
    held = F.array_sort(F.collect_list(F.struct("run", span.alias("t"))))
    texts = merged.groupBy("path", "p").agg(F.array_join(F.transform(held, lambda s: s.t), "").alias("html"))
    return lookup.looked_up(props, texts, {"path": "path", "p": "p"}, {"html": ""})


def _joined(order: str, text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s.t), "")


def _lists(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared styles, and formats of numbers by level, as written tables: what tells lists from other paragraphs."""
    declared = written(style_table(members).select("path", "style", "based_on", "name", "num_id", "level"))
    return declared, written(numbering(members).groupBy("path", "num_id", "level").agg(F.min("format").alias("format")))


def numbered_paragraphs(paras: DataFrame, members: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``paras`` with the numbering of their styles where they have none of their own, and tag (ul, ol, or null for no list); P12, J15.

    A style without a numbering takes that of the nearest style it is based on; a number of 0 is none.
    """
    declared, formats = known or _lists(members)
    if declared.where("num_id is not null").isEmpty():
        return _with_formats(paras, formats)
    own = F.when(F.col("num_id").isNotNull(), F.struct("num_id", F.coalesce("level", F.lit(0)).alias("level")))
    nearest = closure.folded(declared.withColumnsRenamed({"style": "node", "based_on": "parent"}), own, F.coalesce, "numbering", ["path"])
    nearest = nearest.where("numbering is not null").groupBy("path", F.col("node").alias("style")).agg(F.min("numbering.num_id").alias("style_num"), F.min("numbering.level").alias("style_level"))
    rows = lookup.looked_up(paras, nearest, {"path": "path", "style": "style"}, {"style_num": None, "style_level": None})
    rows = rows.withColumn("level", F.coalesce("level", F.when(F.col("num_id").isNull(), F.col("style_level")))).withColumn("num_id", F.coalesce("num_id", "style_num"))
    return _with_formats(rows.drop("style_num", "style_level"), formats)


def _with_formats(rows: DataFrame, formats: DataFrame) -> DataFrame:
    """Adds tag (ul, ol, or null for no list) by the format of each paragraph's number and level."""
    rows = rows.withColumn("level", F.coalesce("level", F.lit(0)))
    rows = lookup.looked_up(rows, formats, {"path": "path", "num_id": "num_id", "level": "level"}, {"format": "decimal"})
    return rows.withColumn("tag", F.when(F.col("num_id") >= 1, F.when(F.col("format") == "bullet", "ul").otherwise("ol"))).drop("format")


def body_lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, p (of the first item), breaks and html of each list: neighbouring paragraphs of one numbering, nested by their levels; W5, P8."""
    islands = runs.islands(rows, keys, ["p"], F.when(F.col("tag").isNotNull(), F.col("num_id")), "island").where("tag is not null")
    made = emit.nested_lists(islands, [*keys, "island"], "p")
    breaks = islands.groupBy(*keys, "island").agg(F.bool_or("breaks").alias("breaks"))
    return made.join(breaks, [*keys, "island"]).select(*keys, F.col("start").alias("p"), "breaks", "html")


SIDES = ("bottom", "top", "right", "left")
# Conditions of rows that a table's style names.
BANDS = ("band1Horz", "band2Horz", "firstRow", "lastRow")


def _cell_declarations(prefix: str = "") -> list[tuple[str, Column]]:
    """Aggregates over a cell's or style's properties: width, background and borders as (CSS property, value); C34."""
    shade = _value("shd", "fill")
    out = [("background-color", F.when(shade != "auto", F.concat(F.lit("#"), shade)))]
    for side in SIDES:
        kind, size, color = (_value(side, a) for a in ("val", "sz", "color"))
        px = F.coalesce(F.round(size.try_cast("double") / 4).cast("int").cast("string"), F.lit(""))
        drawn = F.concat(px, F.lit("px "), css_of.word_border(kind), F.lit(" #"), F.when(color == "auto", "000000").otherwise(F.coalesce(color, F.lit(""))))
        out.append((f"border-{side}", F.when(kind.isNotNull() & (kind != "nil"), drawn)))
    return out


def _as_map(parts: list[tuple[str, Column]]) -> Column:
    return F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in parts)), F.array(*(v for _, v in parts))), lambda k, v: v.isNotNull())


def table_styles(members: DataFrame) -> DataFrame:
    """path, style, ord, condition (null for the whole table) and props of the cells of each declared table style, in document order; C34, W10."""
    tree = owned(owned(nodes(members.where("member = 'word/styles.xml'")), "style").where("style is not null"), "tblStylePr")
    at = lambda tag, key: F.max(F.when(F.col("tag") == tag, F.try_element_at("attrs", F.lit(key))))
    names = tree.where("node_id = style").groupBy("path", F.col("style").alias("of")).agg(at("style", "styleId").alias("style"), at("style", "type").alias("type")).where("type = 'table'")
    rows = tree.groupBy("path", F.col("style").alias("of"), F.coalesce("tblStylePr", F.lit(-1)).alias("ord")).agg(at("tblStylePr", "type").alias("condition"), _as_map(_cell_declarations()).alias("props"))
    return rows.join(names, ["path", "of"]).select("path", "style", "ord", "condition", "props")


def body_cells(members: DataFrame, tree: DataFrame) -> DataFrame:
    """path, tbl, tr, tc, row, col (from 0, in the table's grid), rowspan, colspan and style of each cell that is shown; P9.

    A cell's column comes after those that the cells before it span. Cells that go on with the one above are part of it, and its span counts them.
    Its own properties go before those of the table's style, and these before those of the row's place: first, last, and
    the bands of odd and even rows, of which the style's last one counts.
    """
    top = tree.where("tag = 'tc' and node_id = tc").select("path", F.col("tc").alias("of"), F.col("depth").alias("top"))
    own = tree.where("tc is not null").join(top, [tree["path"] == top["path"], tree["tc"] == top["of"]]).drop(top["path"]).where("depth <= top + 3")
    merge = F.when(F.bool_or(F.col("tag") == "vMerge"), F.coalesce(_value("vMerge"), F.lit("continue")))
    width = F.when(_value("tcW").isNull() & _value("tcW", "w").isNotNull() & (F.coalesce(_value("tcW", "type"), F.lit("dxa")) == "dxa"), F.substring_index(cell_width(_value("tcW", "w").try_cast("double")), ":", -1))
    cells = own.groupBy("path", "tbl", "tr", "tc").agg(F.greatest(F.coalesce(_value("gridSpan").try_cast("int"), F.lit(1)), F.lit(1)).alias("colspan"), merge.alias("merge"), _as_map([("width", width), *_cell_declarations()]).alias("props"))
    skipped = tree.where("tag = 'gridBefore' and tr is not null and tc is null").groupBy("path", "tr").agg(_value("gridBefore").try_cast("int").alias("skipped"))
    in_row = Window.partitionBy("path", "tbl", "tr").orderBy("tc").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(skipped, ["path", "tr"], "left").withColumn("col", F.coalesce(F.sum("colspan").over(in_row), F.lit(0)) + F.coalesce("skipped", F.lit(0)))
    cells = cells.withColumn("row", F.dense_rank().over(Window.partitionBy("path", "tbl").orderBy("tr")) - 1)
    down = Window.partitionBy("path", "tbl", "col").orderBy("row")
    goes_on = (F.col("merge") == "continue") & (F.lag("row").over(down) == F.col("row") - 1) & F.lag("merge").over(down).isNotNull()
    cells = cells.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("block", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(down))
    cells = cells.withColumn("rowspan", F.count("*").over(Window.partitionBy("path", "tbl", "col", "block")).cast("int")).withColumn("rows", F.max("row").over(Window.partitionBy("path", "tbl")) + 1).where("not goes_on")
    named = tree.where("tag = 'tblStyle' and tbl is not null and tr is null").groupBy("path", "tbl").agg(_value("tblStyle").alias("style"))
    declared = table_styles(members).join(named, ["path", "style"]).select("path", "tbl", "ord", "condition", "props")
    whole = declared.where("condition is null").select("path", "tbl", F.col("props").alias("whole"))
    fits = (F.col("condition") == "firstRow") & (F.col("row") == 0) | (F.col("condition") == "lastRow") & (F.col("row") == F.col("rows") - 1) | (F.col("condition") == "band2Horz") & (F.col("row") % 2 == 0) | (F.col("condition") == "band1Horz") & (F.col("row") % 2 == 1)
    lines = cells.select("path", "tbl", "tr", "row", "rows").distinct().join(declared.where(F.col("condition").isin(*BANDS)), ["path", "tbl"]).where(fits)
    lines = lines.groupBy("path", "tbl", "tr").agg(F.max_by("props", "ord").alias("line"))
    cells = cells.join(whole, ["path", "tbl"], "left").join(lines, ["path", "tbl", "tr"], "left")
    none = F.create_map().cast("map<string,string>")
    over = lambda a, b: F.map_concat(a, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))
    props = over(over(F.col("props"), F.coalesce("whole", none)), F.coalesce("line", none))
    style = F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(e.key, F.lit(":"), e.value)), ";")
    return cells.select("path", "tbl", "tr", "tc", "row", "col", "rowspan", "colspan", style.alias("style"))


def body_tables(members: DataFrame, paras: DataFrame, tree: DataFrame | None = None, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """path, tbl and html of each table of the body; its cells hold their paragraphs' texts and lists; P9, P18. ``paras``: ``body_paragraphs``."""
    tree = body(members) if tree is None else tree
    inside = numbered_paragraphs(paras.where("tc is not null"), members, known)
    plain = inside.where("tag is null").select("path", "tc", "p", "html")
    listed = body_lists(inside, ["path", "tc"]).select("path", "tc", "p", "html")
    texts = plain.unionByName(listed).groupBy("path", "tc").agg(_joined("p", "html").alias("text"))
    cells = lookup.looked_up(body_cells(members, tree), texts, {"path": "path", "tc": "tc"}, {"text": ""})
    return emit.tables(cells, ["path", "tbl"], 0, 0)


def body_blocks(members: DataFrame) -> DataFrame:
    """path, ord, kind, tag (of a heading or paragraph), breaks and html of each block of the body: headings, paragraphs, lists and tables; P8, W5.

    Neighbouring list paragraphs of one numbering are one list, nested by their levels, each ordered unless its format is a bullet's.
    """
    tree = body(members)
    paras = written(body_paragraphs(members, tree))
    known = _lists(members)
    flow = numbered_paragraphs(paras.where("tbl is null"), members, known).withColumnRenamed("tag", "list")
    names = lookup.first_of(known[0], ["path", "style"], ["name"], ["name"])
    flow = lookup.looked_up(flow, names, {"path": "path", "style": "style"}, {"name": F.regexp_replace("style", "^Heading ?([1-6])$", "heading $1")})
    heading = F.when(F.lower("name").rlike("^heading [1-6]$"), css_of.heading(F.lower("name")))
    listed = body_lists(flow.withColumnRenamed("list", "tag"), ["path"])
    listed = listed.select("path", F.col("p").alias("ord"), F.lit("list").alias("kind"), F.lit(None).cast("string").alias("tag"), "breaks", "html")
    plain = flow.where("list is null").withColumn("tag", F.coalesce(heading, F.lit("p")))
    plain = plain.select("path", F.col("p").alias("ord"), F.when(F.col("tag") == "p", "paragraph").otherwise("heading").alias("kind"), "tag", "breaks", F.concat(F.lit("<"), "tag", F.lit(">"), "html", F.lit("</"), "tag", F.lit(">")).alias("html"))
    if paras.where("tc is not null").isEmpty():
        return plain.unionByName(listed)
    tables = body_tables(members, paras, tree, known).select("path", F.col("tbl").alias("ord"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("tag"), F.lit(False).alias("breaks"), "html")
    return plain.unionByName(listed).unionByName(tables)


def body_pages(members: DataFrame) -> DataFrame:
    """path, page_no, title and html of each page of the body: a page starts at a heading of the first level or at a page break; P8, W6."""
    blocks = runs.split_at(body_blocks(members), ["path"], ["ord"], (F.col("tag").eqNullSafe(F.lit("h1"))) | F.col("breaks"), "page")
    first = F.min("page").over(Window.partitionBy("path"))
    blocks = blocks.withColumn("page_no", F.col("page") - first + 1)
    title = F.min_by(F.when(F.col("tag") == "h1", F.regexp_replace("html", "<[^>]*>", "")), F.when(F.col("tag") == "h1", F.col("ord")))
    return blocks.groupBy("path", "page_no").agg(title.alias("title"), _joined("ord", "html").alias("html"))


def _style_nodes(members: DataFrame) -> DataFrame:
    return owned(owned(nodes(members.where("member = 'word/styles.xml'")), "style").where("style is not null"), "tblStylePr")


def style_properties(members: DataFrame) -> DataFrame:
    """path, style, based_on, css: each declared style with its own run and paragraph properties; S29, C33."""
    tree = _style_nodes(members).where("tblStylePr is null")
    at = lambda key: F.max(F.when(F.col("tag") == "style", F.try_element_at("attrs", F.lit(key))))
    css = F.concat_ws(";", F.nullif(_declarations(), F.lit("")), F.nullif(_paragraph_declarations(), F.lit("")))
    return tree.groupBy("path", F.col("style").alias("node")).agg(at("styleId").alias("style"), _value("basedOn").alias("based_on"), css.alias("css")).drop("node")


def style_table(members: DataFrame) -> DataFrame:
    """path, style, based_on, name, type, num_id and level (of its numbering) of each declared style; S29, P12."""
    tree = _style_nodes(members)
    at = lambda tag, key: F.max(F.when(F.col("tag") == tag, F.try_element_at("attrs", F.lit(key))))
    out = tree.groupBy("path", F.col("style").alias("node")).agg(at("style", "styleId").alias("style"), _value("basedOn").alias("based_on"), _value("name").alias("name"), at("style", "type").alias("type"), _value("numId").try_cast("int").alias("num_id"), _value("ilvl").try_cast("int").alias("level"))
    return out.drop("node")


def numbering(members: DataFrame) -> DataFrame:
    """path, num_id, level, format: numId to abstractNum to level; J15."""
    tree = nodes(members.where("member = 'word/numbering.xml'"))
    child = tree.select("path", F.col("parent_id").alias("up"), F.col("tag").alias("child"), F.col("attrs")["val"].alias("val"))
    num = tree.where("tag = 'num'").join(child.where("child = 'abstractNumId'").withColumnRenamed("up", "node_id"), ["path", "node_id"]).select("path", F.col("attrs")["numId"].alias("num_id"), F.col("val").alias("abstract"))
    abstract = tree.where("tag = 'abstractNum'").select("path", F.col("node_id").alias("a"), F.col("attrs")["abstractNumId"].alias("abstract"))
    level = tree.where("tag = 'lvl'").select("path", F.col("node_id").alias("l"), F.col("parent_id").alias("a"), F.col("attrs")["ilvl"].alias("level"))
    form = child.where("child = 'numFmt'").select("path", F.col("up").alias("l"), F.col("val").alias("format"))
    out = num.join(abstract, ["path", "abstract"]).join(level, ["path", "a"]).join(form, ["path", "l"])
    return out.select("path", F.col("num_id").cast("int").alias("num_id"), F.col("level").cast("int").alias("level"), "format")


#: Kinds of pictures that browsers don't show.
UNSHOWN = ("emf", "wmf", "pict")


def pictures(members: DataFrame) -> DataFrame:
    """path, p, ord (from 1 in a document), member, name, width and height (inches), alt and html of each picture of the body; K12, K14.

    A picture names a relationship, which names the member with its bytes. Of one that can't be shown, html says so.
    """
    tree = owned(owned(document_nodes(members).where("node_id is not null"), "p"), "drawing").where("drawing is not null")
    rows = tree.groupBy("path", "drawing").agg(
        F.first("p").alias("p"), _value("blip", "embed").alias("rel"), _value("extent", "cx").try_cast("double").alias("cx"), _value("extent", "cy").try_cast("double").alias("cy"),
        F.coalesce(_value("docPr", "title"), F.lit("")).alias("title"), F.coalesce(_value("docPr", "descr"), F.lit("")).alias("descr"),
    )
    links = nodes(members.where("member = 'word/_rels/document.xml.rels'")).where("tag = 'Relationship'")
    links = links.select("path", F.try_element_at("attrs", F.lit("Id")).alias("rel"), F.concat(F.lit("word/"), F.try_element_at("attrs", F.lit("Target"))).alias("member"))
    rows = lookup.looked_up(runs.numbered(rows.where("rel is not null"), ["path"], ["drawing"], "ord"), links, {"path": "path", "rel": "rel"}, {"member": None}, inner=True)
    name = F.regexp_extract("member", "([^/]*)$", 1)
    inches = lambda c: F.round(F.col(c) / 914400, 4)
    alt = F.concat_ws(": ", F.nullif("title", F.lit("")), F.nullif("descr", F.lit("")))
    rows = rows.select("path", "p", "ord", "member", name.alias("name"), inches("cx").alias("width"), inches("cy").alias("height"), alt.alias("alt"))
    size = F.concat(F.lit("width: "), css_of.number(F.col("width")), F.lit("in; height: "), css_of.number(F.col("height")), F.lit("in; display: initial"))
    ident = F.concat(F.lit("image_"), F.lower(F.replace("name", F.lit(" "), F.lit(""))), F.lit("_"), F.col("ord").cast("string"))
    shown = F.concat(F.lit('<figure><img style="'), size, F.lit('" src="../images/'), _escaped(F.col("name")), F.lit('" alt="'), _escaped(F.col("alt")), F.lit('" title="'), _escaped(F.col("alt")), F.lit('" id="'), ident, F.lit('"></figure>'))
    missing = F.concat(F.lit("<p>The picture "), _escaped(F.col("name")), F.lit(" has a format that can't be shown.</p>"))
    return rows.withColumn("html", F.when(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(*UNSHOWN), missing).otherwise(shown))


def picture_files(members: DataFrame) -> DataFrame:
    """path, name, content: the bytes of each picture that can be shown, once; K3, K14."""
    used = pictures(members).where(~F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(*UNSHOWN)).select("path", "member", "name").distinct()
    return members.join(used, ["path", "member"]).select("path", "name", "content")
