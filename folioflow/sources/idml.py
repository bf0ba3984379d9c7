"""IDML packages: design map, stories, spreads, tags, colours, styles and fonts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import colors, css, decoders, text
from folioflow.operators import paths, runs, styles
from folioflow.sources.xml import ALL, _attrs, nodes, tagged
from folioflow.storage import spread, written


def _named(members: DataFrame, pattern: str, owners: dict = {}) -> DataFrame:  # noqa: B006
    return nodes(members.where(F.col("member").rlike(pattern)), owners=owners)


def _deleted(e) -> bool:
    """Whether an element is a change that deletes what is in it."""
    return tagged("Change")(e) and _attrs(e).get("ChangeType") == "DeletedText"


def design_map(members: DataFrame) -> DataFrame:
    """path, ord, kind, src of each part that the design map names, in order; S19."""
    rows = _named(members, r"^designmap\.xml$").where("attrs['src'] is not null")
    return rows.select("path", F.col("node_id").alias("ord"), F.col("tag").alias("kind"), F.col("attrs")["src"].alias("src"))


def layers(members: DataFrame) -> DataFrame:
    """path, layer, z, visible: z is the order in the design map; W13, J18."""
    from folioflow.operators.runs import numbered

    rows = _named(members, r"^designmap\.xml$").where("tag = 'Layer'")
    return numbered(rows, ["path"], ["node_id"], "z", 0).select("path", F.col("attrs")["Self"].alias("layer"), "z", (F.lower(F.col("attrs")["Visible"]) == "true").alias("visible"))


def hyperlinks(members: DataFrame) -> DataFrame:
    """path, source, destination; S19, J4."""
    rows = _named(members, r"^designmap\.xml$").where("tag = 'Hyperlink'")
    return rows.select("path", F.col("attrs")["Source"].alias("source"), F.col("attrs")["Destination"].alias("destination"))


def tag_names(members: DataFrame) -> DataFrame:
    """S24."""
    return _named(members, r"^XML/Tags\.xml$").where("tag = 'XMLTag'").select("path", F.col("attrs")["Self"].alias("self"), F.col("attrs")["Name"].alias("name"))


def palette(members: DataFrame) -> DataFrame:
    """path, self, hex: colours, and tints of them; a tint without its colour is black; S25, J9."""
    tree = _named(members, r"^Resources/Graphic\.xml$")
    base = tree.where("tag = 'Color'").select("path", F.col("attrs")["Self"].alias("self"), colors.to_rgb(F.col("attrs")["Space"], F.col("attrs")["ColorValue"]).alias("rgb"))
    tints = tree.where("tag = 'Tint'").select("path", F.col("attrs")["Self"].alias("tint"), F.col("attrs")["BaseColor"].alias("self"), F.col("attrs")["TintValue"].cast("double").alias("percent"))
    black = F.array(F.lit(0), F.lit(0), F.lit(0))
    tinted = tints.join(base, ["path", "self"], "left").select("path", F.col("tint").alias("self"), colors.tint(F.coalesce("rgb", black), F.col("percent")).alias("rgb"))
    return base.unionByName(tinted).select("path", "self", colors.to_hex(F.col("rgb")).alias("hex"))


def _graphic(members: DataFrame) -> DataFrame:
    return _named(members, r"^Resources/Graphic\.xml$").select("path", "node_id", "parent_id", "tag", "attrs")


def swatches(members: DataFrame) -> DataFrame:
    """path, swatches: all colours, tints and gradients of a package by name, as :data:`folioflow.functions.decoders.SWATCH`; S25.

    Colours come first, then tints in document order, each of a colour or an earlier tint (one without its base is left out), then
    gradients, whose stops name either; a stop of another kind has no colour. Of two with one name the last counts. A package's
    swatches are one map: they are as many as a designer's panel holds.
    """
    tree = written(_graphic(members))
    at = lambda name: F.try_element_at("attrs", F.lit(name))
    rgb = colors.to_rgb(at("Space"), at("ColorValue"))
    color = tree.where("tag = 'Color'").groupBy("path", at("Self").alias("self")).agg(F.max_by(rgb, "node_id").alias("rgb")).where("self is not null")
    color = color.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("self", "rgb"))).alias("colors"))
    percent = F.coalesce(at("TintValue").try_cast("double"), F.lit(0.0))
    tints = tree.where("tag = 'Tint'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("node_id", at("Self").alias("self"), at("BaseColor").alias("base"), percent.alias("percent")))).alias("tints"))
    ref = at("StopColor")
    stops = tree.where("tag = 'GradientStop'").select("path", F.col("parent_id").alias("of"), F.struct("node_id", ref.alias("ref"), F.round(F.coalesce(at("Location").try_cast("double"), F.lit(0.0)), 1).alias("location")).alias("stop"))
    stops = stops.groupBy("path", "of").agg(F.array_sort(F.collect_list("stop")).alias("stops"))
    kinds = tree.where("tag = 'Gradient'").select("path", F.col("node_id").alias("of"), at("Self").alias("self"), at("Type").alias("kind")).join(stops, ["path", "of"], "left").where("self is not null")
    kinds = kinds.groupBy("path", "self").agg(F.max_by(F.struct("kind", "stops"), "of").alias("g")).groupBy("path").agg(F.collect_list(F.struct("self", "g.kind", "g.stops")).alias("gradients"))
    rows = tree.select("path").distinct().join(color, "path", "left").join(tints, "path", "left").join(kinds, "path", "left")
    none = F.create_map().cast("map<string, array<int>>")

    def tinted(known, t):
        made = F.create_map(t.self, colors.tint(F.try_element_at(known, t.base), t.percent))
        return F.when(t.self.isNotNull() & F.map_contains_key(known, F.coalesce(t.base, F.lit(""))), F.map_concat(F.map_filter(known, lambda k, v: k != t.self), made)).otherwise(known)

    known = F.aggregate(F.coalesce("tints", F.array().cast("array<struct<node_id: int, self: string, base: string, percent: double>>")), F.coalesce("colors", none), tinted)
    # written, as a filter on what is made of it would fold all tints again for each stop
    rows = written(spread(rows, "path").select("path", "gradients", known.alias("known")))
    black = F.array(F.lit(0), F.lit(0), F.lit(0))
    hex_of = lambda ref: F.when(F.substring_index(ref, "/", 1).isin("Color", "Ink", "MixedInk", "Tint"), colors.to_hex(F.coalesce(F.try_element_at(F.col("known"), ref), black))).otherwise("")
    flat = F.transform_values("known", lambda k, v: F.struct(v.alias("rgb"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("array<struct<rgb: string, location: double>>").alias("stops")))
    shade = lambda g: F.struct(F.lit(None).cast("array<int>").alias("rgb"), g.kind.alias("kind"), F.transform(g.stops, lambda s: F.struct(hex_of(F.coalesce(s.ref, F.lit(""))).alias("rgb"), s.location.alias("location"))).alias("stops"))
    shades = F.map_from_entries(F.transform("gradients", lambda g: F.struct(g.self, shade(g))))
    both = F.when(F.col("gradients").isNull(), flat).otherwise(F.map_concat(F.map_filter(flat, lambda k, v: ~F.array_contains(F.transform("gradients", lambda g: g.self), k)), shades))
    return rows.select("path", both.alias("swatches"))


def layer_map(members: DataFrame) -> DataFrame:
    """path, layers: z and visible of a package's layers by name; J18."""
    rows = layers(members).groupBy("path", "layer").agg(F.max_by(F.struct("z", "visible"), "z").alias("at")).where("layer is not null")
    return rows.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("layer", "at"))).alias("layers"))


def style_rules(members: DataFrame, inherited: bool = True) -> DataFrame:
    """path, style, ord, target, selector, property, value: the CSS rules of all declared styles, with what they inherit; D1, A12."""
    declared = written(declared_styles(members))
    props = styles.flattened(declared, ["path"]) if inherited else declared.select("path", "style", "props")
    rows = props.join(declared.select("path", "style", "kind"), ["path", "style"]).join(swatches(members), "path", "left").join(layer_map(members), "path", "left")
    return decoders.rule_rows(rows, ["path"], "style", kind=F.col("kind"), swatches=F.col("swatches"), layers=F.col("layers"))


def style_sheets(members: DataFrame, inherited: bool = True) -> DataFrame:
    """path, style, css of each declared style; K11."""
    declared = declared_styles(members)
    kinds = list(decoders.SUFFIX.items())
    suffix = css.mapped(F.col("kind"), dict(kinds), "")
    names = declared.select("path", "style", "kind", F.coalesce("name", F.lit("")).alias("name"), suffix.alias("suffix"))
    rules = style_rules(members, inherited).join(names, ["path", "style"])
    of = F.coalesce(*(F.when(F.col("kind") == k, text.class_name(F.col("name"), x)) for k, x in kinds))
    return decoders.style_sheets(rules, ["path"], "style", of)


def fonts(members: DataFrame) -> DataFrame:
    """path, family, font, style; S27."""
    tree = _named(members, r"^Resources/Fonts\.xml$")
    family = tree.where("tag = 'FontFamily'").select("path", F.col("node_id").alias("parent_id"), F.col("attrs")["Name"].alias("family"))
    return tree.where("tag = 'Font'").join(family, ["path", "parent_id"]).select("path", "family", F.col("attrs")["PostScriptName"].alias("font"), F.col("attrs")["FontStyleName"].alias("style"))


#: Kinds of declared styles.
STYLES = ("CharacterStyle", "ParagraphStyle", "ObjectStyle", "TableStyle", "CellStyle")


def declared_styles(members: DataFrame) -> DataFrame:
    """path, style, kind, name, based_on, props of each declared style of the five kinds; S26.

    props: the paths of its attributes and of the elements below it, with their values, in document order. A parent's name
    without a kind in front is one of the style's own kind; no parent is null.
    """
    tree = nodes(members.where(F.col("member").rlike(r"^Resources/Styles\.xml$")), ALL)
    rows = paths.path_maps(paths.path_entries(tree, F.col("tag").isin(*STYLES)))
    get = lambda name: F.try_element_at("props", F.lit(name))
    above = F.nullif(get("Properties::BasedOn"), F.lit(""))
    above = F.when(F.startswith(above, F.col("kind")), above).otherwise(F.concat("kind", F.lit("/"), above))
    props = F.map_filter("props", lambda k, v: ~k.isin("Self", "Name", "Properties::BasedOn"))
    return rows.select("path", get("Self").alias("style"), "kind", get("Name").alias("name"), above.alias("based_on"), props.alias("props"))


def _under(tree: DataFrame, mark) -> DataFrame:
    """``tree`` with under: whether a node is, or is below, one for which ``mark`` holds. Subtrees are intervals in preorder, so the furthest end seen so far tells."""
    w = Window.partitionBy("path", "member").orderBy("node_id")
    return tree.withColumn("under", F.coalesce(F.max(F.when(mark, F.col("last"))).over(w) >= F.col("node_id"), F.lit(False)))


def story_text(members: DataFrame) -> DataFrame:
    """path, story, text: the contents of each story in order, without deleted text and what is changed inside of it; S23, F7, J11."""
    rows = _named(members, r"^Stories/Story_.*\.xml$", {"gone": _deleted}).where("tag = 'Content' and gone is null")
    parts = F.array_sort(F.collect_list(F.struct("node_id", "text")))
    return rows.groupBy("path", F.regexp_extract("member", r"Story_(.*)\.xml$", 1).alias("story")).agg(F.array_join(F.transform(parts, lambda s: s.text), "").alias("text"))


RANGES = ("ParagraphStyleRange", "CharacterStyleRange")


def story_paragraphs(members: DataFrame) -> DataFrame:
    """path, story, paragraph (from 0), style (applied to it, or null) and html of each paragraph of each story, without deleted text; P16, D37.

    A paragraph goes on up to a break. Neighbouring texts of one character style are one span; classes are those of ``style_sheets``.
    """
    rows = _named(members, r"^Stories/Story_.*\.xml$", {**{tag: tagged(tag) for tag in RANGES}, "gone": _deleted}).where("node_id is not null")
    style = lambda tag, name: F.last(F.when((F.col("tag") == tag) & (F.col("node_id") == F.col(tag)), F.struct(F.try_element_at("attrs", F.lit(name)).alias("ref"))), ignorenulls=True)
    w = Window.partitionBy("path", "member").orderBy("node_id")
    rows = rows.withColumn("paragraph_style", F.when(F.col(RANGES[0]).isNotNull(), style(RANGES[0], "AppliedParagraphStyle").over(w).ref)).withColumn("character_style", F.when(F.col(RANGES[1]).isNotNull(), style(RANGES[1], "AppliedCharacterStyle").over(w).ref))
    rows = rows.where("tag in ('Content', 'Br') and gone is null").select("path", F.regexp_extract("member", r"Story_(.*)\.xml$", 1).alias("story"), "node_id", "tag", "text", "paragraph_style", "character_style")
    of = Window.partitionBy("path", "story").orderBy("node_id")
    rows = rows.withColumn("paragraph", F.coalesce(F.sum(F.when(F.col("tag") == "Br", 1).otherwise(0)).over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = runs.merged(rows.where("tag = 'Content'"), ["path", "story", "paragraph"], ["node_id"], F.col("character_style"), text.escape(F.col("text")))
    name = style_class(F.col("style"))
    span = F.when(F.coalesce(name, F.lit("")) == "", F.col("text")).otherwise(F.concat(F.lit('<span class="'), name, F.lit('">'), "text", F.lit("</span>")))
    held = F.array_sort(F.collect_list(F.struct("run", span.alias("t"))))
    inside = spans.groupBy("path", "story", "paragraph").agg(F.array_join(F.transform(held, lambda s: s.t), "").alias("inside"))
    styled = rows.groupBy("path", "story", "paragraph").agg(F.min_by("paragraph_style", "node_id").alias("style"))
    rows = styled.join(inside, ["path", "story", "paragraph"], "left")
    name = style_class(F.col("style"))
    open_ = F.concat(F.lit("<p"), F.coalesce(F.concat(F.lit(' class="'), F.nullif(name, F.lit("")), F.lit('"')), F.lit("")), F.lit(">"))
    return rows.select("path", "story", "paragraph", "style", F.concat(open_, F.coalesce(F.nullif("inside", F.lit("")), F.lit("&#160;")), F.lit("</p>")).alias("html"))


def style_class(ref) -> Column:
    """The class name of a style by its reference, ``Kind/name``; none for no style; C28, J26."""
    kind = F.substring_index(ref, "/", 1)
    name = F.replace(F.substr(ref, F.length(kind) + 2), F.lit("%3a"), F.lit(":"))
    plain = F.coalesce(ref, F.lit("")).rlike(r"^$|\$ID/\[No ")
    return F.when(~plain, F.coalesce(*(F.when(kind == k, text.class_name(name, x)) for k, x in decoders.SUFFIX.items())))


def story_html(members: DataFrame) -> DataFrame:
    """path, story, html: the paragraphs of each story."""
    held = F.array_sort(F.collect_list(F.struct("paragraph", "html")))
    return story_paragraphs(members).groupBy("path", "story").agg(F.array_join(F.transform(held, lambda s: s.html), "").alias("html"))


def page_count(members: DataFrame) -> DataFrame:
    """path, pages: before any spread is parsed whole; S30, A1."""
    rows = _named(members, r"^Spreads/.*\.xml$").where("tag = 'Spread' and attrs['PageCount'] is not null")
    return rows.groupBy("path").agg(F.sum(F.col("attrs")["PageCount"].cast("int")).alias("pages"))


def hidden_ids(members: DataFrame, marker: str = "Hidden") -> DataFrame:
    """path, id of each node at or below a hidden marker in the backing story; S22, F5."""
    tree = _named(members, r"^XML/BackingStory\.xml$")
    rows = _under(tree, F.contains(F.try_element_at("attrs", F.lit("MarkupTag")), F.lit(marker))).where("under and attrs['XMLContent'] is not null")
    return rows.select("path", F.col("attrs")["XMLContent"].alias("id")).distinct()
