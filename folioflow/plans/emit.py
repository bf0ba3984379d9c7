"""Queries of markup written out, rewritten and cleaned, and of the property functions that they need."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import css, geometry, text, word
from folioflow.operators import emit, lookup, markup, styles
from folioflow.plans.flow import events
from folioflow.plans.scalars import _DOCS, _PAGES, _PART, _case, _choose, _pick, c, scalar
from folioflow.registry import query

_W = "(partition by user_id order by event_id)"
_s = lambda x: c(x).cast("string")
_d = lambda x: c(x).cast("double")

# --- properties ---
_ALIGNED = [*css.ALIGN, "AwayFromBindingSide", "ToBindingSide", "Other"]
scalar(
    "C19_binding_alignment", _PART, lambda: css.binding_alignment(_choose(_ALIGNED), _choose(["left", "right"], "b")),
    f"case {_pick(_ALIGNED)} when 'AwayFromBindingSide' then case when b % 2 = 0 then 'left' else 'right' end when 'ToBindingSide' then case when b % 2 = 0 then 'right' else 'left' end else {_case(_pick(_ALIGNED), css.ALIGN, repr('left'))} end",
)
scalar("C19_unit", _PART, lambda: css.unit(_choose(["unit", "pixel", "other"])), "case when a % 3 = 1 then 'px' else 'pt' end")
scalar("C44_text_turn", _PART, lambda: css.text_turn(_choose([*css.TEXT_TURN, "lrTb"])), _case(_pick([*css.TEXT_TURN, "lrTb"]), css.TEXT_TURN, "''"))
_VERTICAL = [*css.FRAME_VERTICAL, "TopAlign"]
scalar("D22_frame_vertical", _PART, lambda: css.frame_vertical(_choose(_VERTICAL)), "case a % 3 when 0 then '> div{position:relative;display:table-cell;vertical-align:bottom}' when 1 then '> div{position:relative;display:table-cell;vertical-align:middle}' else '' end")
for _name, _sides in (("D29_table_borders", ("top", "right", "bottom", "left")), ("D30_cell_borders", ("left", "bottom", "right", "top"))):
    scalar(
        _name, _PART, lambda sides=_sides: F.concat_ws(";", *(css.side_stroke(s, F.when(c(x) % 3 > 0, c(x) / 4.0 - 1), F.when(c(x) % 2 == 0, F.lit("StrokeStyle/$ID/Dashed")), F.when(c(x) % 5 == 0, F.lit("#00ff00"))) for s, x in zip(sides, "abcn"))),
        " || ';' || ".join(
            f"case when {x} % 3 > 0 and {x} / 4.0::double - 1 <= 0 then 'border-{s}:none' else 'border-{s}:' || case when {x} % 3 > 0 then cast(round({x} / 4.0::double - 1) as int) else 1 end || 'px ' || case when {x} % 2 = 0 then 'dashed' else 'solid' end || ' ' || case when {x} % 5 = 0 then '#00ff00' else '#000000' end end"
            for s, x in zip(_sides, "abcn")
        ),
    )
_inset = lambda x: f"cast(round(case when {x} % 2 = 0 then {x} / 8.0::double else 0 end) as int)"
scalar(
    "D31_cell_padding", _PART, lambda: css.cell_padding(*(F.when(c(x) % 2 == 0, c(x) / 8.0) for x in "abcn")),
    f"case when {_inset('a')} = {_inset('b')} and {_inset('b')} = {_inset('c')} and {_inset('c')} = {_inset('n')} then 'padding:' || {_inset('a')} || 'px' else 'padding:' || {_inset('a')} || 'px ' || {_inset('b')} || 'px ' || {_inset('c')} || 'px ' || {_inset('n')} || 'px' end",
)
scalar("D33_clip", _PART, lambda: css.clip(_choose(["true", "false"])), "case when a % 2 = 0 then 'overflow:hidden' end")
scalar("D35_svg_color", _PART, lambda: css.svg_color(_choose(["Color/Red", "Swatch/None", "Gradient/Sky"]), F.lit("#ff0000"), "none"), "case when a % 3 = 0 then '#ff0000' else 'none' end")
scalar(
    "K11_padded_rule", _PART, lambda: css.padded_rule(F.concat(F.lit(".c"), _s("id")), F.array(F.struct(F.lit("color").alias("key"), F.lit("red").alias("value")), F.struct(F.repeat(F.lit("k"), c("n").cast("int")).alias("key"), _s("a").alias("value")))),
    "'.c' || id || ' {' || chr(10) || chr(9) || 'color                      : red;' || chr(10) || chr(9) || rpad(repeat('k', n::int), 26, ' ') || ' : ' || a || ';' || chr(10) || '}'",
)

# --- word-processor styles ---
_STYLE = lambda: F.concat(
    F.lit('<w:style><w:rPr><w:rFonts w:ascii="F'), _s("n"), F.lit('"/><w:color w:val="'), F.when(c("a") % 2 == 0, "auto").otherwise("ff0000"), F.lit('"/><w:sz w:val="'), _s("n"), F.lit('"/>'),
    F.when(c("b") % 2 == 0, "<w:b/>").otherwise(""), F.when(c("b") % 3 == 0, "<w:i/>").otherwise(""), F.lit('</w:rPr><w:pPr><w:spacing w:before="'), _s("a"), F.lit('" w:after="'), _s("b"),
    F.lit('"/><w:ind w:firstLine="'), (c("c") % 3 * 40).cast("string"), F.lit('" w:left="'), _s("c"), F.lit('"/></w:pPr></w:style>'),
)
_twips = lambda x: f"cast(round({x} / 11.0::double) as int) || 'px'"
scalar(
    "C33_word_style", _PART, lambda: word.style(_STYLE()),
    f"'margin-top:' || {_twips('a')} || ';margin-bottom:' || {_twips('b')} || ';font-family:F' || n || ';color:#' || case when a % 2 = 0 then '000000' else 'ff0000' end || ';font-size:' || (n // 2) || 'pt' || case when b % 2 = 0 then ';font-weight:bold' else '' end || "
    f"case when b % 3 = 0 then ';font-style:italic' else '' end || ';text-indent:' || case when c % 3 = 0 then {_twips('c')} else {_twips('c % 3 * 40')} end",
)
scalar(
    "C34_word_borders", _PART, lambda: word.borders(F.concat(F.lit('<w:tcBorders><w:bottom w:val="'), _choose(["single", "nil", "dashed"]), F.lit('" w:sz="'), _s("b"), F.lit('" w:color="auto"/><w:left w:val="double" w:sz="'), _s("c"), F.lit('" w:color="00ff00"/></w:tcBorders>'))),
    "case when a % 3 = 1 then '' else 'border-bottom:' || cast(round(b / 4.0::double) as int) || 'px ' || case when a % 3 = 0 then 'solid' else 'dashed' end || ' #000000;' end || 'border-left:' || cast(round(c / 4.0::double) as int) || 'px double #00ff00'",
)
scalar("C34_cell_width", _PART, lambda: word.cell_width(c("price")), "'width:' || cast(round(price / 15.1::double) as int) || 'px'")
scalar("C4_run_text", _DOCS, lambda: word.run_text(c("text")), """replace(replace(replace(replace(regexp_replace(text, '(\\r\\n|\\n|\\r)', '<br />\\1', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')""")
scalar("C1_entities", _PAGES, lambda: text.numeric_entities(F.concat(c("html"), F.lit("&copy;&middot;&amp;copy;&nosuch;"))), "replace(replace(replace(html, '&copy;', '&#169;'), '&middot;', '&#183;'), '&nbsp;', '&#160;') || '&#169;&#183;&amp;copy;&nosuch;'")

# --- geometry and shapes ---
_B = lambda: geometry.box(_d("a"), _d("b"), _d("c"), _d("n"))
_TOP, _LEFT, _BOTTOM, _RIGHT = "least(a, c)", "least(b, n)", "greatest(a, c)", "greatest(b, n)"
scalar("C21_box_center", _PART, lambda: (lambda s: s.width * 1e6 + s.height * 1e3 + s.x + s.y / 1e3)(geometry.size_and_center(_B())), f"({_RIGHT} - {_LEFT}) * 1e6::double + ({_BOTTOM} - {_TOP}) * 1e3::double + ({_LEFT} + {_RIGHT}) / 2.0::double + ({_TOP} + {_BOTTOM}) / 2.0::double / 1e3::double")
scalar("C21_moved_box", _PART, lambda: (lambda b: b.top * 1e3 + b.left)(geometry.moved(_B(), F.lit(5.0), F.lit(7.0))), f"cast(({_TOP} - 7) * 1000 + {_LEFT} - 5 as double)")
scalar("C24_on_page", _PART, lambda: (lambda p: p.left * 1e3 + p.top)(geometry.on_page(_B(), geometry.box(F.lit(3.0), F.lit(4.0), F.lit(900.0), F.lit(900.0)), F.lit(1.0))), f"cast(({_LEFT} - 5) * 1000 + {_TOP} - 4 as double)")
_V = lambda: F.array(*(F.struct(_d(x).alias("x"), _d(y).alias("y"), (_d(x) + 1).alias("lx"), (_d(y) + 2).alias("ly")) for x, y in ("ab", "bc", "cn")))
_POINTS = " || ' ' || ".join(f"({x} - {_LEFT} + 2) || ',' || ({y} - {_TOP} + 2)" for x, y in ("ab", "bc", "cn"))
_PATH = f"'M' || (a - {_LEFT}) || ',' || (b - {_TOP})" + "".join(f" || ' Q' || ({x} + 1 - {_LEFT}) || ',' || ({y} + 2 - {_TOP}) || ' ' || ({x} - {_LEFT}) || ',' || ({y} - {_TOP})" for x, y in ("bc", "cn"))
scalar("C37_vertex_points", _PART, lambda: geometry.vertex_points(_V(), _B(), F.lit(2.0)), _POINTS)
scalar("C37_path_points", _PART, lambda: geometry.path_points(_V(), _B()), _PATH)
scalar("P19_shapes", _PART, lambda: emit.shape(c("n") % 2 == 0, geometry.path_points(_V(), _B()), geometry.vertex_points(_V(), _B(), F.lit(2.0))), f"""case when n % 2 = 0 then '<path d="' || {_PATH} || '" />' else '<polygon points="' || {_POINTS} || '" />' end""")

# --- fragments ---
scalar("P11_toc_row", _PART, lambda: emit.toc_row(_s("id"), F.repeat(c("name"), (c("n") % 15).cast("int")), _s("n")), "'<tr><td>' || id || '</td><td>' || case when length(repeat(name, n % 15)) < 140 then rpad(repeat(name, n % 15), 140, '.') else repeat(name, n % 15) end || '</td><td>' || n || '</td></tr>'")
scalar("P17_anchor", _PART, lambda: emit.anchor(_s("id"), F.when(c("n") % 2 == 0, F.concat(F.lit("#"), _s("a"))), c("name")), """case when n % 2 = 0 then '<a href="#' || a || '">' else '<a id="Hyperlink_' || id || '">' end || name || '</a>'""")
scalar("P20_image", _PART, lambda: emit.image(F.concat(c("brand"), F.lit("&1.png")), c("n") % 2 == 0), """case when n % 2 = 0 then '<image xlink:href="' || brand || '&amp;1.png" />' else '<img src="' || brand || '&amp;1.png" style="width:100%; height:100%;" />' end""")
scalar("P21_tab", _PART, lambda: emit.tab(F.when(c("n") % 3 > 0, c("a") / 4.0)), """case when n % 3 > 0 then '<span style="display:inline-block;width:' || cast(round(a / 4.0::double) as int) || 'px"></span>' else chr(9) end""")
scalar("F14_artefacts", _PART, lambda: markup.is_artefact(F.concat(F.when(c("n") % 2 == 0, "editor-item ").otherwise(""), F.when(c("a") % 3 == 0, "editor-picture ").otherwise(""), c("brand")), "editor-item", ("editor-picture", "editor-sound")), "n % 2 = 0 and a % 3 > 0")
scalar("O3_sorted_signature", _PART, lambda: styles.sorted_signature(F.array(F.concat(F.lit("w:"), _s("n")), F.concat(F.lit("a:"), _s("a")), F.concat(F.lit("m:"), c("brand")))), "md5('a:' || a || ';m:' || brand || ';w:' || n)")
scalar("A22_kept_attribute", _PART, lambda: text.kept_attribute(_s("n"), c("n") % 4 != 0, c("brand")), "case when n % 4 <> 0 then n::varchar else brand end")

# --- rewrites of pages ---
_TABLE = '<table class="t" width="50%" border="1" cellpadding="" style="color:red"><tr cellspacing="2"><td>x</td></tr></table>'
_TABLE_OUT = '<table class="t" style="color:red; max-width: 50%; border: 1"><tr style="border-collapse: separate; border-spacing: 2"><td>x</td></tr></table>'
scalar("P3_table_styles", _PAGES, lambda: markup.table_styles(F.concat(c("html"), F.lit(_TABLE))), f"html || '{_TABLE_OUT}'")
_MATH = f'<html xmlns:m="{markup.MATHML}"><m:math><m:mi>x</m:mi><annotation-xml encoding="application/xhtml+xml"><p>y</p></annotation-xml></m:math></html>'
_MATH_OUT = f'<html><math xmlns="{markup.MATHML}"><mi xmlns="{markup.MATHML}">x</mi><annotation-xml encoding="application/xhtml+xml"><p xmlns="{markup.XHTML}">y</p></annotation-xml></math></html>'
scalar("P4_math_namespace", _PAGES, lambda: markup.math_namespace(F.concat(F.lit(_MATH), c("html"))), f"'{_MATH_OUT}' || html")
scalar(
    "P1_page_transition", _PAGES, lambda: text.with_stylesheet(text.with_stylesheet(markup.math_namespace(markup.table_styles(text.without_declaration(F.concat(F.lit('<?xml version="1.0"?>'), c("html"), F.lit(_TABLE))))), "a.css"), "b.css"),
    f"""replace(html, '</head>', '<link rel="stylesheet" type="text/css" href="a.css" /><link rel="stylesheet" type="text/css" href="b.css" /></head>') || '{_TABLE_OUT}'""",
)

_HOLLOW = '<div><p><b></b><i> </i></p><div><u></u><span style="color:red"><em></em></span></div><span style="width:3px"></span><td></td></div>'
_HOLLOW_LEFT = '<div><p><i> </i></p><span style="width:3px"></span><td></td></div>'
_EMPTIES = "|".join(f"<{t}(?:[ ][^>]*)?></{t}>" for t in ("a", "article", "b", "div", "em", "footer", "h1", "i", "li", "nav", "p", "script", "style", "title", "u", "ul"))
scalar(
    "F12_pruned", _PAGES, lambda: markup.pruned(F.concat(c("html"), F.lit(_HOLLOW))),
    f"""(with recursive r as (select html as h, 0 as k union all select regexp_replace(h, '{_EMPTIES}', '', 'g'), k + 1 from r where regexp_matches(h, '{_EMPTIES}')) select arg_max(h, k) from r) || '{_HOLLOW_LEFT}'""",
)

_CSS = "\n.text_style1 {a:b}\n.common_style2 {c:d}\n.common_span_style3 {e:f}\n.other {g:h}"


@query(
    "F13_used_rules",
    """select page_id, case when page_id % 3 = 1 then chr(10) || '.text_style1 {a:b}' else '' end || case when page_id % 3 = 2 then chr(10) || '.common_style2 {c:d}' else '' end || case when page_id % 3 = 0 then chr(10) || '.common_span_style3 {e:f}' else '' end as css from pages""",
)
def used_rules(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    used = F.concat(F.lit('<div class="x '), F.get(F.array(F.lit("common_span_style3"), F.lit("text_style1"), F.lit("common_style2")), (F.col("page_id") % 3).cast("int")), F.lit('"></div>'))
    return rows.select("page_id", markup.used_rules(F.lit(_CSS), F.concat("html", used)).alias("css"))


@query("P14_fragments", "select doc_id, cast(unnest(range(0, len(f))) as bigint) as ord, case when unnest(f) = chr(9) then 'tab' else 'text' end as kind, unnest(f) as fragment from (select doc_id, regexp_extract_all(replace(text, '. ', chr(9)), '\\t|[^\\t]+') as f from documents)")
def fragments(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.replace("text", F.lit(". "), F.lit("\t")).alias("text"))
    return emit.fragments(rows, ["doc_id"], "text")


@query(
    "P16_paragraphs",
    f"""with b as (select *, event_type = 'purchase' as br, coalesce(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as block from events)
    select user_id, cast(block as bigint) as block, '<div>' || coalesce(string_agg('<span class="' || event_type || '">' || event_id || '</span>', '' order by event_id) filter (not br), '&#160;') || '</div>' as html from b group by user_id, block""",
)
def paragraphs(spark, sf_dir):
    return emit.paragraphs(events(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_type") == "purchase", F.col("event_type"), F.col("event_id").cast("string"))


@query(
    "P18_tables",
    """with l as (select o_custkey, o_orderkey, string_agg(cell, '' order by l_linenumber, cell) as cells from (select *, '<@' || case when l_linenumber % 4 = 0 then ' rowspan="0"' else '' end || case when l_linenumber % 3 = 2 then ' colspan="2"' else '' end || '>' || l_quantity::int || '</@>' as cell from lineitem) join orders on o_orderkey = l_orderkey group by all),
    n as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n, count(*) over (partition by o_custkey) as k from l),
    p as (select *, case when n = 1 then 'thead' when n = k then 'tfoot' else 'tbody' end as part from n),
    r as (select *, replace(replace(cells, '<@', case when part = 'thead' then '<th' else '<td' end), '</@>', case when part = 'thead' then '</th>' else '</td>' end) as c, lag(part) over o as before, lead(part) over o as after from p window o as (partition by o_custkey order by o_orderkey))
    select o_custkey, '<table>' || string_agg(case when before is null or before <> part then '<' || part || '>' else '' end || '<tr>' || c || '</tr>' || case when after is null or after <> part then '</' || part || '>' else '' end, '' order by o_orderkey) || '</table>' as html from r group by o_custkey""",
)
def tables(spark, sf_dir):
    line, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    n = F.col("l_linenumber")
    cells = line.join(orders, line.l_orderkey == orders.o_orderkey).select("o_custkey", F.col("o_orderkey").alias("row"), n.alias("col"), F.when(n % 4 == 0, 0).otherwise(1).alias("rowspan"), F.when(n % 3 == 2, 2).otherwise(1).alias("colspan"), F.col("l_quantity").cast("int").cast("string").alias("text"))
    return emit.tables(cells, ["o_custkey"], 1, 1)


@query(
    "K9_serialized_trees",
    """with g as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by event_id) as g, row_number() over (partition by user_id order by event_id) as n from events),
    s as (select user_id, g, '<section g="' || g || '">' || string_agg('<p id="' || event_id || '">' || event_type || '</p>', '' order by event_id) || '</section>' as html from g group by user_id, g)
    select user_id, '<body>' || string_agg(html, '' order by g) || '</body>' as html from s group by user_id""",
)
def serialized_trees(spark, sf_dir):
    from pyspark.sql import Window

    rows = events(spark, sf_dir).withColumn("g", F.sum((F.col("event_type") == "signup").cast("int")).over(Window.partitionBy("user_id").orderBy("event_id")))
    none, blank = F.create_map().cast("map<string,string>"), F.lit("")
    leaf = rows.select("user_id", (F.col("event_id") * 4 + 3).alias("pre"), F.lit(2).alias("depth"), F.lit("p").alias("tag"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("attrs"), F.col("event_type").alias("text"))
    section = rows.groupBy("user_id", "g").agg(F.min("event_id").alias("first")).select("user_id", (F.col("first") * 4 + 2).alias("pre"), F.lit(1), F.lit("section"), F.create_map(F.lit("g"), F.col("g").cast("string")), blank)
    root = rows.select("user_id").distinct().select("user_id", F.lit(-1).cast("long"), F.lit(0), F.lit("body"), none, blank)
    return emit.serialized(leaf.union(section).union(root), ["user_id"])


@query("J5_bound_frames", "select user_id, event_id, min(case when event_type = 'purchase' then event_id end) over (partition by user_id order by event_id rows between current row and unbounded following) as bound from events qualify event_type = 'click'")
def bound_frames(spark, sf_dir):
    rows = emit.bound_frames(events(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_type") == "click", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return rows.select("user_id", "event_id", "bound")


@query(
    "W3_counters",
    f"""with l as (select *, case event_type when 'signup' then 0 when 'view' then 1 else 2 end as lv from events), a as (select *, sum(case when lv = 0 then 1 else 0 end) over {_W} as c0 from l), b as (select *, sum(case when lv = 1 then 1 else 0 end) over (partition by user_id, c0 order by event_id) as c1 from a),
    d as (select *, sum(case when lv = 2 then 1 else 0 end) over (partition by user_id, c0, c1 order by event_id) as c2 from b) select user_id, event_id, c0 || case when lv > 0 then '.' || c1 else '' end || case when lv > 1 then '.' || c2 else '' end as number from d""",
)
def counters(spark, sf_dir):
    level = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return emit.counters(events(spark, sf_dir), ["user_id"], ["event_id"], level).select("user_id", "event_id", "number")


@query("F8_empty_pages", "select o_custkey from orders group by o_custkey having bool_or(o_orderkey % 3 = 0)")
def empty_pages(spark, sf_dir):
    return lookup.present(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey"], F.col("o_orderkey") % 3 == 0)


@query("F9_first_frames", "select o_orderkey from (select *, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as prev from orders) where prev is null")
def first_frames(spark, sf_dir):
    return lookup.first_of(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey"], ["o_orderkey"], ["o_orderkey"]).select("o_orderkey")


@query("J7_rewritten_hrefs", f"select o_orderkey, coalesce(p_brand || '.xhtml', 'k' || (o_orderkey % 5000)) as href from orders left join part on p_partkey = o_orderkey % 5000")
def rewritten_hrefs(spark, sf_dir):
    orders, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "part"))
    links = orders.select("o_orderkey", (F.col("o_orderkey") % 5000).alias("key"))
    names = part.select("p_partkey", F.concat("p_brand", F.lit(".xhtml")).alias("href"))
    return lookup.looked_up(links, names, {"key": "p_partkey"}, {"href": F.concat(F.lit("k"), F.col("key").cast("string"))}).drop("key")


@query("J21_bookmark_numbers", "select o_orderkey, regexp_extract(p_name || p_size, '[0-9.]+', 0) as number from orders join part on 'b' || p_partkey = 'b' || (o_custkey % 700)")
def bookmark_numbers(spark, sf_dir):
    orders, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "part"))
    marks = part.select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("at"), F.regexp_extract(F.concat("p_name", F.col("p_size").cast("string")), "[0-9.]+", 0).alias("number"))
    probes = orders.select("o_orderkey", F.concat(F.lit("b"), (F.col("o_custkey") % 700).cast("string")).alias("mark"))
    return lookup.looked_up(probes, marks, {"mark": "at"}, {"number": None}, inner=True).select("o_orderkey", "number")


@query("J25_nodes_by_hash", "select coalesce(case when p_size % 3 = 0 then 'h' || p_size end, md5(p_brand || '.' || p_type)) as hash, min(p_partkey) as node, count(*) as uses from part group by 1")
def nodes_by_hash(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.coalesce(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("h"), F.col("p_size").cast("string"))), styles.digest("p_brand", "p_type"))
    return lookup.counted_first(part.select(key.alias("hash"), F.col("p_partkey").alias("node")), ["hash"], "node")
