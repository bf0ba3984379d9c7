"""Queries of layout packages whose XML has the shape that layout programs write: a package for every fifty rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import colors
from folioflow.operators import paths, styles
from folioflow.plans.sources import _joined, _member, _t
from folioflow.registry import query
from folioflow.sources import idml, spreads, xml

_NS = 'xmlns:idPkg="urn:idPkg"'


def _tag(name: str, text="", **attrs):
    """An element; attributes and text are columns or strings, and an attribute that is null is left out."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v.cast("string")
    said = [F.coalesce(F.concat(F.lit(f' {k.replace("__", ":")}="'), lit(v), F.lit('"')), F.lit("")) for k, v in attrs.items()]
    return F.concat(F.lit(f"<{name}"), *said, F.lit(">"), lit(text), F.lit(f"</{name}>"))


def _wrapped(rows, order: str, name: str, xml_text, root: str):
    """A member for each path: the elements of its rows in order."""
    packed = rows.groupBy("path").agg(_joined(order, xml_text).alias("xml"))
    return _member(packed, name, F.concat(F.lit(f"<{root} {_NS}>"), "xml", F.lit(f"</{root}>")))


def _parts(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    parent = F.when(k % 50 > 0, k - k % 50 + F.floor((k % 50 - 1) / 2))
    return part.select(F.floor(k / 50).cast("string").alias("path"), k.alias("k"), parent.alias("up"), F.col("p_size").alias("n"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))


#: The same columns in SQL.
_P = "p as (select (p_partkey // 50)::varchar as path, p_partkey as k, case when p_partkey % 50 > 0 then p_partkey - p_partkey % 50 + (p_partkey % 50 - 1) // 2 end as up, p_size as n, p_type as type, p_brand as brand from part)"


def _style_members(spark, sf_dir):
    """Styles that are based on each other as a binary tree in each package, with fonts, tabs and a page element that isn't theirs."""
    name = lambda c: F.concat(F.lit("ParagraphStyle/"), F.col(c).cast("string"))
    based = F.when(F.col("up").isNotNull(), _tag("BasedOn", name("up"), type="object")).otherwise("")
    tabs = _tag("TabList", F.concat(_tag("ListItem", F.col("n")), _tag("ListItem", F.col("n") + 1)))
    inner = F.concat(based, _tag("AppliedFont", F.col("type"), type="string"), tabs)
    style = _tag("ParagraphStyle", F.concat(_tag("Properties", inner), _tag("TextFrame", _tag("Label", "no"), Self="f")), Self=name("k"), Name=F.col("brand"), PointSize=F.col("n"), Tracking=F.when(F.col("n") % 4 == 0, F.col("n") * 10))
    return _wrapped(_parts(spark, sf_dir), "k", "Resources/Styles.xml", F.concat(F.lit("<ParagraphStyleGroup>"), style, F.lit("</ParagraphStyleGroup>")), "idPkg:Styles")


@query(
    "S31_path_keys",
    f"""with {_P}, s as (select *, 'ParagraphStyle/' || k as style, case when up is null then '' else 'ParagraphStyle/' || up end as based from p)
    select path, style, unnest(['Self', 'Name', 'PointSize', 'Tracking', 'Properties', 'Properties::BasedOn', 'Properties::BasedOn->type', 'Properties::AppliedFont', 'Properties::AppliedFont->type', 'Properties::TabList', 'Properties::TabList::ListItem', 'Properties::TabList::ListItem2']) as key,
      unnest([style, brand, n::varchar, case when n % 4 = 0 then (n * 10)::varchar end, based || type || n || (n + 1), nullif(based, ''), case when up is not null then 'object' end, type, 'string', n || '' || (n + 1), n::varchar, (n + 1)::varchar]) as value from s""",
)
def path_keys(spark, sf_dir):
    tree = xml.nodes(_style_members(spark, sf_dir), xml.ALL)
    rows = paths.path_maps(paths.path_entries(tree, F.col("tag").isin(*idml.STYLES)))
    rows = rows.select("path", F.col("props")["Self"].alias("style"), "props")
    # a key that a style doesn't have is a row of null, as in the SQL
    keys = ["Self", "Name", "PointSize", "Tracking", "Properties", "Properties::BasedOn", "Properties::BasedOn->type", "Properties::AppliedFont", "Properties::AppliedFont->type", "Properties::TabList", "Properties::TabList::ListItem", "Properties::TabList::ListItem2"]
    every = F.array_distinct(F.concat(F.array(*map(F.lit, keys)), F.map_keys("props")))
    return rows.select("path", "style", F.explode(F.transform(every, lambda k: F.struct(k.alias("key"), F.try_element_at("props", k).alias("value")))).alias("e")).select("path", "style", "e.key", "e.value")


_NEAREST = f"""with recursive {_P}, w as (select path, k, k as here, 0 as d from p union all select w.path, w.k, p.up, d + 1 from w join p on p.k = w.here where p.up in (select k from p)),
    t as (select w.path, w.k, arg_min(p.n, d) as n from w join p on p.k = w.here where p.n % 4 = 0 group by all)"""


@query("A12_declared_inheritance", f"{_NEAREST} select p.path, 'ParagraphStyle/' || p.k as style, p.n::varchar as size, (t.n * 10)::varchar as tracking, type as font from p left join t using (k)")
def declared_inheritance(spark, sf_dir):
    flat = styles.flattened(idml.declared_styles(_style_members(spark, sf_dir)), ["path"])
    get = lambda key: F.try_element_at("props", F.lit(key))
    return flat.select("path", "style", get("PointSize").alias("size"), get("Tracking").alias("tracking"), get("Properties::AppliedFont").alias("font"))


@query(
    "D1_style_rules",
    f"""{_NEAREST}, r as (select p.path, 'ParagraphStyle/' || p.k as style, unnest(['margin', 'padding', 'border', 'font-family', 'font-size', 'line-height', 'letter-spacing']) as property,
      unnest(['0', '0', 'none', case when contains(type, ' ') then '''' || type || '''' else type end, p.n || 'px', '120%', regexp_replace((t.n * 10 / 1000.0::double)::varchar, '[.]0$', '') || 'em']) as value from p left join t using (k))
    select path, style, 'own' as target, property, value from r where value is not null""",
)
def style_rules(spark, sf_dir):
    return idml.style_rules(_style_members(spark, sf_dir)).select("path", "style", "target", "property", "value")


@query(
    "K11_style_sheets",
    f"""{_NEAREST} select p.path, 'ParagraphStyle/' || p.k as style, '.' || replace(brand, '#', '') || 'Para {{' || chr(10) || array_to_string(list_transform(list_filter([['margin', '0'], ['padding', '0'], ['border', 'none'],
      ['font-family', case when contains(type, ' ') then '''' || type || '''' else type end], ['font-size', p.n || 'px'], ['line-height', '120%'], ['letter-spacing', regexp_replace((t.n * 10 / 1000.0::double)::varchar, '[.]0$', '') || 'em']], lambda x: x[2] is not null),
      lambda x: chr(9) || rpad(x[1], 26, ' ') || ' : ' || x[2] || ';' || chr(10)), '') || '}}' as css from p left join t using (k)""",
)
def style_sheets(spark, sf_dir):
    return idml.style_sheets(_style_members(spark, sf_dir))


@query(
    "S25_swatch_graph",
    f"""with {_P}, c as (select path, k, n, printf('#%02x00ff', n) as color, printf('#%02x80ff', cast(round(n + (255 - n) * 0.5) as int)) as half, printf('#%02xc0ff', cast(round(round(n + (255 - n) * 0.5) + (255 - round(n + (255 - n) * 0.5)) * 0.5) as int)) as quarter from p)
    select path, 'Gradient/' || k as self, 'linear-gradient(' || (90 - n) || 'deg, ' || quarter || ' 0%, ' || color || ' 33.3%, #000000 100%)' as linear, 'radial-gradient(circle closest-side, ' || quarter || ' 0%, ' || color || ' 33.3%, #000000 100%)' as radial from c""",
)
def swatch_graph(spark, sf_dir):
    name = lambda kind: F.concat(F.lit(kind if "/" in kind else f"{kind}/"), F.col("k").cast("string"))
    stops = F.concat(_tag("GradientStop", StopColor=name("Tint/q"), Location="0"), _tag("GradientStop", StopColor=name("Color"), Location="33.333"), _tag("GradientStop", StopColor="Color/none", Location="100"))
    swatch = F.concat(
        _tag("Gradient", stops, Self=name("Gradient"), Type="Linear"), _tag("Color", Self=name("Color"), Space="RGB", ColorValue=F.concat(F.col("n").cast("string"), F.lit(" 0 255"))),
        _tag("Tint", Self=name("Tint"), BaseColor=name("Color"), TintValue="50"), _tag("Tint", Self=name("Tint/q"), BaseColor=name("Tint"), TintValue="50"),
    )
    parts = _parts(spark, sf_dir)
    held = idml.swatches(_wrapped(parts, "k", "Resources/Graphic.xml", swatch, "idPkg:Graphic"))
    rows = held.select("path", F.explode("swatches").alias("self", "swatch")).where("swatch.kind is not null")
    sizes = parts.select(F.concat(F.lit("Gradient/"), F.col("k").cast("string")).alias("self"), F.col("n").cast("double").alias("angle"))
    return rows.join(sizes, "self").select("path", "self", colors.gradient(F.col("angle"), F.col("swatch.stops")).alias("linear"), colors.radial_gradient(F.col("swatch.stops")).alias("radial"))


def _anchors(w: int, h: int) -> str:
    return "<Properties><PathGeometry><GeometryPathType><PathPointArray>" + "".join(f'<PathPointType Anchor="{x} {y}"/>' for x, y in ((0, 0), (0, h), (w, h), (w, 0))) + "</PathPointArray></GeometryPathType></PathGeometry></Properties>"


#: An item for each customer; each ten lie on one spread, which has one to three pages, and a tenth of them are masters' items.
_C = """c as (select c_custkey as k, c_custkey // 50 as pkg, c_custkey // 10 as sp, c_custkey // 10 % 3 + 1 as n, c_custkey * 37 % 1000 - 500 as tx, c_custkey * 91 % 500 - 250 as ty, c_custkey % 4 = 0 as turned, c_custkey % 5 = 0 as grouped from customer)"""


def _customers(spark, sf_dir):
    return _t(spark, sf_dir, "customer").selectExpr("c_custkey as k", "cast(c_custkey div 50 as string) as path", "c_custkey div 10 as sp", "cast(c_custkey div 10 % 3 + 1 as int) as n", "c_custkey * 37 % 1000 - 500 as tx", "c_custkey * 91 % 500 - 250 as ty", "c_custkey % 4 = 0 as turned", "c_custkey % 5 = 0 as grouped")


def _spread_members(spark, sf_dir):
    """Spreads of ten items each, some turned by a right angle and some groups of one moved shape, and a master spread for each package, based on another."""
    rows, s = _customers(spark, sf_dir), lambda c: F.col(c).cast("string")
    matrix = F.concat(F.when(F.col("turned"), "0 1 -1 0 ").otherwise("1 0 0 1 "), s("tx"), F.lit(" "), s("ty"))
    shape = _tag("Rectangle", _anchors(20, 10), Self=F.concat(F.lit("i"), s("k")), ItemTransform=matrix)
    inner = _tag("Oval", _anchors(20, 10), Self=F.concat(F.lit("o"), s("k")), ItemTransform=F.concat(F.lit("1 0 0 1 0 "), s("n")))
    group = _tag("Group", inner, Self=F.concat(F.lit("i"), s("k")), ItemTransform=matrix)
    body = rows.groupBy("path", "sp", "n").agg(_joined("k", F.when(F.col("grouped"), group).otherwise(shape)).alias("items"))
    page = lambda i: _tag("Page", Self=F.concat(F.lit("p"), s("sp"), F.lit(f"_{i}")), Name=str(i), AppliedMaster=F.concat(F.lit("m"), s("path")), OverrideList=F.when(F.col("sp") % 2 == 0, F.lit("x1 z")).otherwise(""), GeometricBounds="0 0 400 300", ItemTransform=F.concat((F.lit(300 * i) - F.when(F.col("n") > 1, 300).otherwise(0)).cast("string"), F.lit(" -200")))
    page = lambda i, page=page: F.replace(page(i), F.lit('ItemTransform="'), F.lit('ItemTransform="1 0 0 1 '))
    pages = F.concat(*(F.when(F.col("n") > i, page(i)).otherwise("") for i in range(3)))
    one = _tag("idPkg:Spread", _tag("Spread", F.concat(pages, "items"), Self=F.concat(F.lit("s"), s("sp"))), xmlns__idPkg="urn:idPkg")
    out = body.select("path", F.concat(F.lit("Spreads/Spread_"), s("sp"), F.lit(".xml")).alias("member"), F.encode(one, "UTF-8").alias("content"))
    master = lambda name, pages, inside: _tag("idPkg:MasterSpread", _tag("MasterSpread", F.concat(pages, inside), Self=name), xmlns__idPkg="urn:idPkg")
    sheet = lambda name, x, up, hide: F.lit(f'<Page Self="{name}" Name="A" AppliedMaster="{up}" OverrideList="{hide}" GeometricBounds="0 0 400 300" ItemTransform="1 0 0 1 {x} -200"/>')
    thing = lambda name, x: F.lit(f'<Rectangle Self="{name}" ItemTransform="1 0 0 1 {x} 0">{_anchors(20, 10)}</Rectangle>')
    of = rows.select("path").distinct()
    first = of.select("path", F.lit("MasterSpreads/MasterSpread_a.xml").alias("member"), F.encode(master(F.concat(F.lit("m"), "path"), F.concat(sheet("ml", -300, "base", ""), sheet("mr", 0, "base", "z1")), F.concat(thing("x0", -100), thing("x1", 100), thing("x2", 150))), "UTF-8").alias("content"))
    base = of.select("path", F.lit("MasterSpreads/MasterSpread_b.xml").alias("member"), F.encode(master("base", sheet("mb", 0, "n", ""), F.concat(thing("z1", 10), thing("z2", 20))), "UTF-8").alias("content"))
    return out.union(first).union(base)


_PAGES_SQL = f"{_C}, pg as (select distinct pkg, sp, n, i, 'p' || sp || '_' || i as page, 300 * i - case when n > 1 then 300 else 0 end as x from (select *, unnest(range(n)) as i from c))"
#: The middle of each item on its spread: (10, 5) in its own coordinates, the shape in a group lower by n.
_PLACED_SQL = f"{_PAGES_SQL}, m as (select *, case when turned then -1 else 0 end * (5 + case when grouped then n else 0 end) + case when turned then 0 else 10 end + tx as mx, case when turned then 10 else 5 + case when grouped then n else 0 end end + ty as my from c), placed as (select m.*, pg.page from m left join pg on pg.sp = m.sp and mx between x and x + 300 and my between -200 and 200 qualify row_number() over (partition by k order by i) = 1)"


@query("S23_spread_pages", f"with {_PAGES_SQL} select pkg::varchar as path, 's' || sp as spread, page, n as pages, case when x < 0 then 'left' else 'right' end as side, 'm' || pkg as master, x::double as \"left\", 200::double as bottom from pg")
def spread_pages(spark, sf_dir):
    rows = spreads.pages(spreads.spread_nodes(_spread_members(spark, sf_dir))).where("not is_master")
    return rows.select("path", "spread", "page", "pages", "side", "master", "box.left", "box.bottom")


@query(
    "C20_composed_transforms",
    f"with {_C} select pkg::varchar as path, 'o' || k as item, 1 as level, case when turned then 0 else 1 end::double as a, case when turned then 1 else 0 end::double as b, case when turned then tx - n else tx end::double as tx, case when turned then ty else ty + n end::double as ty from c where grouped",
)
def composed_transforms(spark, sf_dir):
    rows = spreads.items(spreads.spread_nodes(_spread_members(spark, sf_dir))).where("tag = 'Oval'")
    return rows.select("path", "item", "level", "world.a", "world.b", "world.tx", "world.ty")


@query("J14_page_items", f"with {_PLACED_SQL} select pkg::varchar as path, unnest(case when grouped then ['i' || k, 'o' || k] else ['i' || k] end) as item, 'i' || k as top, page from placed")
def placed_items(spark, sf_dir):
    tree = spreads.spread_nodes(_spread_members(spark, sf_dir))
    rows = spreads.page_of_items(spreads.items(tree), spreads.pages(tree))
    return rows.where("not startswith(member, 'Master')").select("path", "item", "top", "page")


@query(
    "J10_master_items",
    f"""with {_PLACED_SQL}, own as (select pkg, page, 0 as level, 'i' || k as item from placed where page is not null),
    side as (select *, case when x < 0 then 'left' else 'right' end as side, sp % 2 = 0 as hides from pg),
    taken as (select pkg, page, 1 as level, unnest(case when side = 'left' then ['x0'] when hides then ['x2'] else ['x1', 'x2'] end) as item from side union all select pkg, page, 2, unnest(case when side = 'left' then ['z1', 'z2'] else ['z2'] end) from side)
    select pkg::varchar as path, page, level, item from own union all select pkg::varchar, page, level, item from taken""",
)
def master_items(spark, sf_dir):
    tree = spreads.spread_nodes(_spread_members(spark, sf_dir))
    pages = spreads.pages(tree)
    return spreads.page_items(pages, spreads.page_of_items(spreads.items(tree), pages)).select("path", "page", "level", "item")


def _map_members(spark, sf_dir):
    """A design map for fifty customers: a story and a link for each."""
    rows = _customers(spark, sf_dir)
    k = F.col("k").cast("string")
    part = F.concat(F.lit('<idPkg:Story src="Stories/Story_u'), k, F.lit('.xml"/><Hyperlink Self="h'), k, F.lit('" Source="s'), k, F.lit('" Destination="d'), F.col("n").cast("string"), F.lit('"/>'))
    return _wrapped(rows, "k", "designmap.xml", part, "Document")


@query("S19_parts", "select (c_custkey // 50)::varchar as path, cast(row_number() over (partition by c_custkey // 50 order by c_custkey) * 2 - 1 as int) as ord, 'Story' as kind, 'Stories/Story_u' || c_custkey || '.xml' as src from customer")
def parts(spark, sf_dir):
    return idml.design_map(_map_members(spark, sf_dir))


@query("S19_links", "select (c_custkey // 50)::varchar as path, 's' || c_custkey as source, 'd' || (c_custkey // 10 % 3 + 1) as destination from customer")
def links(spark, sf_dir):
    return idml.hyperlinks(_map_members(spark, sf_dir))


@query(
    "P16_story_paragraphs",
    """select (k0 // 50)::varchar as path, 'u' || (k0 // 10) as story, cast(k0 % 10 // 2 as bigint) as paragraph, 'ParagraphStyle/P' || (k0 % 3) as style, '<p class="P' || (k0 % 3) || 'Para">' || html || '</p>' as html
    from (select min(c_custkey) as k0, string_agg('<span class="C' || (c_custkey % 2) || 'Char">' || c_custkey || ' &lt;' || c_mktsegment || '&gt;</span>', '' order by c_custkey) as html from customer group by c_custkey // 2)""",
)
def story_paragraphs(spark, sf_dir):
    """A story for ten customers, two to a paragraph, each with a deleted text after it."""
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("m"))
    k = F.col("k")
    text = _tag("Content", F.concat(k.cast("string"), F.lit(" &lt;"), "m", F.lit("&gt;")))
    gone = _tag("Change", _tag("Content", "gone"), ChangeType="DeletedText")
    run = _tag("CharacterStyleRange", F.concat(text, gone, F.when(k % 2 == 1, "<Br/>").otherwise("")), AppliedCharacterStyle=F.concat(F.lit("CharacterStyle/C"), (k % 2).cast("string")))
    part = _tag("ParagraphStyleRange", run, AppliedParagraphStyle=F.concat(F.lit("ParagraphStyle/P"), (k % 3).cast("string")))
    stories = rows.groupBy(F.floor(k / 50).cast("string").alias("path"), F.floor(k / 10).cast("string").alias("s")).agg(_joined("k", part).alias("xml"))
    members = stories.select("path", F.concat(F.lit("Stories/Story_u"), "s", F.lit(".xml")).alias("member"), F.encode(F.concat(F.lit(f"<idPkg:Story {_NS}><Story>"), "xml", F.lit("</Story></idPkg:Story>")), "UTF-8").alias("content"))
    return idml.story_paragraphs(members)
