"""Queries of joins, lookups, closures and filters between layout objects.

The driver's star schema stands in for layout tables: orders are elements, customers the
frames that hold them, suppliers pages, parts styles, nations and regions masters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import filters, layout, lookup, styles
from folioflow.registry import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ELEMENTS = "(select o_custkey % 50 as spread, o_orderkey as element, cast(o_orderkey * 37 % 1200 as double) as x, cast(o_orderkey * 91 % 900 as double) as y from orders)"
_SHEETS = '(select s_suppkey % 50 as spread, s_suppkey as page, s_suppkey as ord, cast(0 as double) as "top", cast(s_suppkey * 7 % 5 * 200 as double) as "left", cast(800 as double) as bottom, cast(s_suppkey * 7 % 5 * 200 + 400 as double) as "right" from supplier)'


def _elements(spark, sf_dir):
    return _t(spark, sf_dir, "orders").selectExpr("o_custkey % 50 as spread", "o_orderkey as element", "cast(o_orderkey * 37 % 1200 as double) as x", "cast(o_orderkey * 91 % 900 as double) as y")


def _sheets(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey % 50 as spread", "s_suppkey as page", "s_suppkey as ord", "cast(0 as double) as top", "cast(s_suppkey * 7 % 5 * 200 as double) as left", "cast(800 as double) as bottom", "cast(s_suppkey * 7 % 5 * 200 + 400 as double) as right"
    )


@query("J14_pages_of_elements", f'select e.spread, element, arg_min(page, ord) as page from {_ELEMENTS} e join {_SHEETS} p on e.spread = p.spread and x between "left" and "right" and y between "top" and bottom group by e.spread, element')
def pages_of_elements(spark, sf_dir):
    return layout.pages_of(_elements(spark, sf_dir), _sheets(spark, sf_dir))


@query("J1_spine_manifest", "select o_orderkey, arg_min(p_partkey, (p_retailprice, p_partkey)) as item from orders join part on p_size = o_orderkey % 60 group by o_orderkey")
def spine_manifest(spark, sf_dir):
    spine = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 60).alias("idref"))
    # the manifest's first row of a key is found before the join, which is then one to one
    manifest = lookup.first_of(_t(spark, sf_dir, "part"), ["p_size"], ["p_retailprice", "p_partkey"], ["p_partkey"]).withColumnRenamed("p_partkey", "item")
    return lookup.looked_up(spine, manifest, {"idref": "p_size"}, {"item": None}, inner=True).select("o_orderkey", "item")


@query("J2_font_rules", "select p_partkey, (select arg_min(c_name, c_custkey) from customer where c_nationkey = p_size % 25 and contains('url(../fonts/' || (c_custkey % 60) || '.otf)', 'fonts/' || (p_partkey % 40) || '.otf')) as family from part")
def font_rules(spark, sf_dir):
    fonts = _t(spark, sf_dir, "part").selectExpr("p_size % 25 as book", "p_partkey", "'fonts/' || (p_partkey % 40) || '.otf' as path")
    rules = _t(spark, sf_dir, "customer").selectExpr("c_nationkey as book", "c_custkey as ord", "c_name as family", "'url(../fonts/' || (c_custkey % 60) || '.otf)' as src")
    found = lookup.containing(fonts.select("book", "path").distinct(), rules, ["book"], "path", "src", ["ord"], ["family"])
    return lookup.looked_up(fonts, found, {"book": "book", "path": "path"}, {"family": None}).select("p_partkey", "family")


@query(
    "J4_resolved_links",
    "select source, case when regexp_matches(destination, '^[a-z]+://') then destination else p_name end as target, case when regexp_matches(destination, '^[a-z]+://') then 'external' when p_partkey is null then 'broken' when p_size % 2 = 0 then 'page' else 'anchor' end as kind "
    "from (select o_orderkey as source, case when o_orderkey % 10 = 0 then 'http://a.example/' || o_orderkey else 'k' || (o_orderkey % 3000) end as destination from orders) left join part on destination = 'k' || p_partkey",
)
def resolved_links(spark, sf_dir):
    sources = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.expr("if(o_orderkey % 10 = 0, 'http://a.example/' || o_orderkey, 'k' || (o_orderkey % 3000))").alias("destination"))
    places = _t(spark, sf_dir, "part").select(F.expr("'k' || p_partkey").alias("key"), F.col("p_name").alias("target"), (F.col("p_size") % 2 == 0).alias("is_page"))
    return layout.resolved_links(sources, places)


@query("J6_last_frame", "select o_custkey, arg_max(o_orderkey, o_orderkey) as frame from orders group by o_custkey")
def last_frame(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumn("frame", F.col("o_orderkey"))
    return lookup.last_of(orders, ["o_custkey"], ["o_orderkey"], ["frame"])


@query("J8_style_fallback", "select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then o_orderpriority end, case when c_custkey % 2 = 0 then c_mktsegment end, n_name, 'default') as style from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey")
def style_fallback(spark, sf_dir):
    orders, customer, nation = (_t(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    own = orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("own"))
    frames = customer.where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment")
    places = lookup.looked_up(customer.select("c_custkey", "c_nationkey"), nation, {"c_nationkey": "n_nationkey"}, {"n_name": None}).select(F.col("c_custkey").alias("place"), "n_name")
    declared = orders.select(F.col("o_orderkey").alias("applied"), "o_orderpriority")
    probes = [(declared, "applied", "o_orderpriority", "own"), (frames, "c_custkey", "c_mktsegment", "o_custkey"), (places, "place", "n_name", "o_custkey")]
    return lookup.first_found(own, probes, "style", "default").select("o_orderkey", "style")


@query("J9_tint_base", "select p_partkey, coalesce(r_name, 'black') as base from part left join region on r_regionkey = p_size % 8")
def tint_base(spark, sf_dir):
    tints = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 8).alias("color"))
    colors = F.broadcast(_t(spark, sf_dir, "region").withColumnRenamed("r_name", "base"))  # a fixed table of 5 rows
    return lookup.looked_up(tints, colors, {"color": "r_regionkey"}, {"base": "black"}).select("p_partkey", "base")


@query("J11_frame_story", "select c_custkey, count(o_orderkey) as items, max(o_orderkey) as last_item from customer left join orders on o_custkey = c_custkey group by c_custkey")
def frame_story(spark, sf_dir):
    return layout.frame_stories(_t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"}, "o_orderkey")


@query("J12_hidden_elements", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def hidden_elements(spark, sf_dir):
    hidden = _t(spark, sf_dir, "customer").where("c_acctbal < 0")
    return lookup.without(_t(spark, sf_dir, "orders"), hidden, {"o_custkey": "c_custkey"}).select("o_orderkey")


@query("J13_master_overrides", "select s_suppkey, n_nationkey from supplier join nation on n_regionkey = s_suppkey % 5 where not exists (select 1 from customer where c_custkey = s_suppkey and c_nationkey = n_nationkey)")
def master_overrides(spark, sf_dir):
    supplier, nation = _t(spark, sf_dir, "supplier"), F.broadcast(_t(spark, sf_dir, "nation"))  # a fixed table of 25 rows
    items = supplier.join(nation, supplier.s_suppkey % 5 == nation.n_regionkey).select("s_suppkey", "n_nationkey")
    return lookup.without(items, _t(spark, sf_dir, "customer"), {"s_suppkey": "c_custkey", "n_nationkey": "c_nationkey"})


@query("J15_numbering_levels", "select o_orderkey, r_name as level from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def numbering_levels(spark, sf_dir):
    orders, customer, nation, region = (_t(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    levels = region.withColumnRenamed("r_name", "level")
    abstract = F.broadcast(lookup.looked_up(nation.select("n_nationkey", "n_regionkey"), levels, {"n_regionkey": "r_regionkey"}, {"level": None}, inner=True))  # at most 25 rows
    numbers = lookup.looked_up(customer.select("c_custkey", "c_nationkey"), abstract, {"c_nationkey": "n_nationkey"}, {"level": None}, inner=True)
    return lookup.looked_up(orders.select("o_orderkey", "o_custkey"), numbers, {"o_custkey": "c_custkey"}, {"level": None}, inner=True).select("o_orderkey", "level")


_TREE = "(select p_partkey as node, case when p_partkey > 0 then p_partkey // 3 end as parent, p_size as size from part)"


@query(
    "J16_nearest_ancestor",
    f"with recursive t as (select * from {_TREE}), w as (select node, parent as at from t union all select w.node, t.parent from w join t on t.node = w.at where t.size % 4 <> 0) select n.node, (select any_value(w.at) from w join t on t.node = w.at where w.node = n.node and t.size % 4 = 0) as ancestor from t n",
)
def nearest_ancestor(spark, sf_dir):
    nodes = _t(spark, sf_dir, "part").selectExpr("p_partkey as node", "if(p_partkey > 0, p_partkey div 3, null) as parent", "p_size as size")
    return layout.ancestors(nodes, F.col("size") % 4 == 0)


@query("J17_cell_rows", "select p_partkey, cast(split_part(c, ':', 1) as int) as col_no, cast(split_part(c, ':', 2) as int) as row_no from (select p_partkey, (p_size % 5) || ':' || (p_partkey % 7) as c from part)")
def cell_rows(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", layout.cell_place(F.expr("(p_size % 5) || ':' || (p_partkey % 7)")).alias("place"))
    return part.select("p_partkey", "place.col_no", "place.row_no")


@query("J20_image_rename", "select p_partkey, '../images/' || coalesce(s_name, 'image' || p_partkey || '.png') as src from part left join supplier on s_suppkey = p_partkey")
def image_rename(spark, sf_dir):
    names = _t(spark, sf_dir, "supplier").withColumnRenamed("s_name", "name")
    images = _t(spark, sf_dir, "part").select("p_partkey")
    default = F.concat(F.lit("image"), F.col("p_partkey").cast("string"), F.lit(".png"))
    return lookup.looked_up(images, names, {"p_partkey": "s_suppkey"}, {"name": default}).select("p_partkey", F.concat(F.lit("../images/"), "name").alias("src"))


@query("J23_filled_metadata", "select c_custkey, coalesce(nullif(case when c_custkey % 3 = 0 then '' else c_mktsegment end, ''), n_name) as publisher from customer left join nation on n_nationkey = c_nationkey")
def filled_metadata(spark, sf_dir):
    customer, nation = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    rows = customer.select("c_custkey", F.expr("if(c_custkey % 3 = 0, '', c_mktsegment)").alias("publisher"))
    more = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select("c_custkey", F.col("n_name").alias("publisher"))
    return layout.filled(rows, more, "c_custkey", ["publisher"])


@query("J26_class_of_style", "select o_orderkey, coalesce(replace(p_brand, '#', ''), '') as class from orders left join part on p_partkey = o_orderkey")
def class_of_style(spark, sf_dir):
    classes = _t(spark, sf_dir, "part").select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("")).alias("class"))
    return lookup.looked_up(_t(spark, sf_dir, "orders").select("o_orderkey"), classes, {"o_orderkey": "p_partkey"}, {"class": ""})


@query(
    "A12_flattened_styles",
    "with recursive t as (select p_partkey as style, case when p_partkey > 0 then p_partkey // 4 end as up, p_size as n, p_brand as brand from part), "
    "w as (select style, style as at, 0 as d from t union all select w.style, t.up, d + 1 from w join t on t.style = w.at where t.up is not null), "
    "p as (select w.style, d, 'size' as k, n::varchar as v from w join t on t.style = w.at where n % 3 = 0 union all select w.style, d, 'brand', brand from w join t on t.style = w.at where n % 2 = 0), "
    "b as (select style, k, arg_min(v, d) as v from p group by style, k) select t.style, max(v) filter (k = 'size') as size, max(v) filter (k = 'brand') as brand from t left join b on b.style = t.style group by t.style",
)
def flattened_styles(spark, sf_dir):
    props = "map_filter(map('size', if(p_size % 3 = 0, cast(p_size as string), null), 'brand', if(p_size % 2 = 0, p_brand, null)), (k, v) -> v is not null)"
    declared = _t(spark, sf_dir, "part").selectExpr("p_partkey as style", "if(p_partkey > 0, p_partkey div 4, null) as based_on", f"{props} as props")
    return styles.flattened(declared).select("style", F.try_element_at("props", F.lit("size")).alias("size"), F.try_element_at("props", F.lit("brand")).alias("brand"))


@query(
    "C23_cumulative_translation",
    "with recursive t as (select p_partkey as node, case when p_partkey > 0 then p_partkey // 4 end as up, p_size as tx from part), w as (select node, up as at, tx from t union all select w.node, t.up, t.tx from w join t on t.node = w.at) select node, cast(sum(tx) as bigint) as tx from w group by node",
)
def cumulative_translation(spark, sf_dir):
    nodes = _t(spark, sf_dir, "part").selectExpr("p_partkey as node", "if(p_partkey > 0, p_partkey div 4, null) as parent", "cast(p_size as bigint) as tx")
    return layout.translations(nodes, F.col("tx")).select("node", F.col("shift").alias("tx"))


@query("A1_page_total", "select n_name, cast(sum(c) as bigint) as pages from (select c_nationkey, count(*) as c from orders join customer on c_custkey = o_custkey group by c_nationkey) join nation on n_nationkey = c_nationkey group by n_name")
def page_total(spark, sf_dir):
    orders, customer, nation = (_t(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    books = lookup.looked_up(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), F.broadcast(nation), {"c_nationkey": "n_nationkey"}, {"n_name": None}, inner=True)
    return lookup.page_totals(orders, books, {"o_custkey": "o_custkey"}, ["n_name"])


@query("A2_bounding_box", f'select spread, min(y) as "top", min(x) as "left", max(y) as bottom, max(x) as "right" from {_ELEMENTS} group by spread')
def bounding_box(spark, sf_dir):
    return layout.bounds(_elements(spark, sf_dir), ["spread"], F.col("y"), F.col("x"), F.col("y"), F.col("x"))


@query("A7_css_per_page", "select o_custkey, string_agg(p, ' ' order by p) as css from (select distinct o_custkey, o_orderpriority as p from orders where o_orderpriority in (select o_orderpriority from orders group by 1 having count(*) > 10)) group by o_custkey")
def css_per_page(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("p"))
    return styles.page_sheets(orders, orders.groupBy("p").count().where("count > 10"), ["o_custkey"], "p")


@query("A11_merged_maps", "select p_partkey, cast(to_json(case when p_size % 2 = 0 then {'color': p_brand, 'size': p_size::varchar} else {'color': p_brand, 'size': p_type} end) as varchar) as props from part")
def merged_maps(spark, sf_dir):
    over = F.map_filter(F.create_map(F.lit("color"), F.col("p_brand"), F.lit("size"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))), lambda k, v: v.isNotNull())
    both = styles.merged(over, F.create_map(F.lit("color"), F.lit("none"), F.lit("size"), F.col("p_type")))
    return _t(spark, sf_dir, "part").select("p_partkey", F.to_json(both).alias("props"))


@query("O7_used_and_declared", "select c_nationkey as k from customer intersect select s_nationkey from supplier except select n_nationkey from nation where n_regionkey = 0")
def used_and_declared(spark, sf_dir):
    used, declared, other = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct(), _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation").where("n_regionkey = 0")
    return lookup.without(lookup.named_in(used, declared, {"k": "s_nationkey"}), other, {"k": "n_nationkey"})


@query("O6_union_rules", "select n_name as name, 'nation' as kind from nation union all select r_name, 'region' from region")
def union_rules(spark, sf_dir):
    a = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return styles.rule_union(a, _t(spark, sf_dir, "region").select(F.lit("region").alias("kind"), F.col("r_name").alias("name")))


@query("K4_asset_routes", "select p_partkey, case when ext in ('png', 'jpg', 'svg') then 'images/' when ext in ('otf', 'ttf') then 'fonts/' when ext = 'mp3' then 'audio/' when ext = 'mp4' then 'video/' end as route from (select p_partkey, ['png', 'svg', 'otf', 'PNG', 'mp3', 'mp4', 'exe', 'ttf', 'jpg'][p_size % 9 + 1] as ext from part)")
def asset_routes(spark, sf_dir):
    from folioflow.sources.files import route

    part = _t(spark, sf_dir, "part").selectExpr("p_partkey", "'a.' || array('png', 'svg', 'otf', 'PNG', 'mp3', 'mp4', 'exe', 'ttf', 'jpg')[p_size % 9] as path")
    return part.select("p_partkey", route(F.col("path")).alias("route"))


@query("F1_valid_sources", "select p_partkey, lower(ext) in ('epub', 'docx') as valid from (select p_partkey, ['epub', 'DOCX', 'txt'][p_size % 3 + 1] as ext from part)")
def valid_sources(spark, sf_dir):
    from folioflow.sources.files import is_source

    part = _t(spark, sf_dir, "part").selectExpr("p_partkey", "'a.' || array('epub', 'DOCX', 'txt')[p_size % 3] as path")
    return part.select("p_partkey", is_source(F.col("path"), ("epub", "docx")).alias("valid"))


@query("F7_tracked_changes", "select event_id, event_type from events where event_type in ('view', 'click', 'purchase')")
def tracked_changes(spark, sf_dir):
    return filters.unchanged(_t(spark, sf_dir, "events"), F.col("event_type"), ("signup", "error")).select("event_id", "event_type")


@query("F16_content_presence", "select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) as has_content from customer")
def content_presence(spark, sf_dir):
    kinds = _t(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return lookup.marked(_t(spark, sf_dir, "customer").select("c_custkey"), kinds, {"c_custkey": "o_custkey"}, "has_content")
