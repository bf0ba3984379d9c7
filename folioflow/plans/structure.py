"""Queries of descendants, delimiters, sorts and sets, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators import closure, layout, lookup, runs, styles
from folioflow.registry import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("W7_break_split", "select doc_id, page, string_agg(line, chr(10) order by i) as text from (select *, cast(sum(case when line = '' or length(line) < 12 then 1 else 0 end) over (partition by doc_id order by i) as bigint) as page from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents)) group by doc_id, page")
def break_split(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    rows = runs.split_at(lines, ["doc_id"], ["i"], F.length("line") < 12)
    parts = F.array_sort(F.collect_list(F.struct("i", "line")))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda s: s.line), "\n").alias("text"))


@query("W12_nth_delimiter", "select doc_id, case when len(w) > 3 then array_to_string(w[1:3], ' ') else text end as styled from (select doc_id, text, string_split(text, ' ') as w from documents)")
def nth_delimiter(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", runs.until_nth(F.col("text"), " ", 3, inclusive=False).alias("styled"))


@query("W16_image_numbers", "select p_partkey, row_number() over (partition by p_brand order by p_partkey) as image_no from part")
def image_numbers(spark, sf_dir):
    return runs.numbered(_t(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], "image_no").select("p_partkey", F.col("image_no").cast("long").alias("image_no"))


@query("O1_package_order", "select s_suppkey, row_number() over (partition by s_nationkey order by s_name) as ord from supplier")
def package_order(spark, sf_dir):
    return runs.numbered(_t(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_name"], "ord").select("s_suppkey", F.col("ord").cast("long").alias("ord"))


@query("O2_page_file_order", "select p_partkey, row_number() over (partition by p_size order by 'page' || p_partkey) as ord from part")
def page_file_order(spark, sf_dir):
    part = _t(spark, sf_dir, "part").withColumn("file", F.concat(F.lit("page"), F.col("p_partkey").cast("string")))
    return runs.numbered(part, ["p_size"], ["file"], "ord").select("p_partkey", F.col("ord").cast("long").alias("ord"))


@query("O5_top_most_match", "select user_id, arg_max(event_type, event_id) filter (event_type in ('click', 'view')) as top from events group by user_id")
def top_most_match(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("top", F.col("event_type"))
    return lookup.last_of(events, ["user_id"], ["event_id"], ["top"], F.col("event_type").isin("click", "view"))


@query("O8_stack_slice", "select conv_id, array_to_string(list_slice(list(role order by turn), 2, 3), '/') as parents from conversations group by conv_id")
def stack_slice(spark, sf_dir):
    rows = runs.slice_of_stack(_t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", 2, 2)
    return rows.select("conv_id", F.array_join("parents", "/").alias("parents"))


@query("A3_group_bounds", "select o_custkey, min(o_orderkey % 97) as left_edge, max(o_orderkey % 97 + case when o_orderstatus = 'F' then 10 else 5 end) as right_edge from orders group by o_custkey")
def group_bounds(spark, sf_dir):
    edge, zero = F.col("o_orderkey") % 97, F.lit(0)
    rows = layout.bounds(_t(spark, sf_dir, "orders"), ["o_custkey"], zero, edge, zero, edge + F.when(F.col("o_orderstatus") == "F", 10).otherwise(5))
    return rows.select("o_custkey", F.col("left").alias("left_edge"), F.col("right").alias("right_edge"))


_TREE = "(select p_partkey as node, case when p_partkey > 0 then p_partkey // 4 end as parent, p_size % 7 = 0 as hit from part)"


@query(
    "A17_has_descendant",
    f"with recursive t as (select * from {_TREE}), w as (select parent as node from t where hit and parent is not null union select t.parent from w join t on t.node = w.node where t.parent is not null) select t.node, w.node is not null as has from t left join w on w.node = t.node",
)
def has_descendant(spark, sf_dir):
    nodes = _t(spark, sf_dir, "part").selectExpr("p_partkey as node", "if(p_partkey > 0, p_partkey div 4, null) as parent", "p_size % 7 = 0 as hit")
    return closure.with_descendant(nodes, F.col("hit"))


@query("A19_book_structure", f"select user_id, event_id, event_type, max(case when event_type = 'signup' then event_id end) over (partition by user_id order by event_id) as chapter, row_number() over (partition by user_id, event_type order by event_id) as sequence from events where event_type in ('signup', 'view')")
def book_structure(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "view"))
    chapter = F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = runs.numbered(rows.withColumn("chapter", chapter), ["user_id", "event_type"], ["event_id"], "sequence")
    return rows.select("user_id", "event_id", "event_type", "chapter", F.col("sequence").cast("long").alias("sequence"))


@query("A20_attribute_union", "select p_partkey, p_brand || ' ' || p_type as class from part")
def attribute_union(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", styles.united(F.col("p_brand"), F.col("p_type")).alias("class"))


@query("A21_used_styles", "select o_custkey, string_agg(distinct coalesce(nullif(o_orderstatus, 'O'), o_orderpriority), ' ' order by coalesce(nullif(o_orderstatus, 'O'), o_orderpriority)) as used from orders group by o_custkey")
def used_styles(spark, sf_dir):
    return styles.used_names(_t(spark, sf_dir, "orders"), ["o_custkey"], F.nullif(F.col("o_orderstatus"), F.lit("O")), F.col("o_orderpriority"))


@query(
    "J10_master_pages",
    "with recursive t as (select p_partkey as page, case when p_partkey > 0 then p_partkey // 5 end as up from part), m as (select page, page as top, 0 as d from t union all select m.page, t.up, d + 1 from m join t on t.page = m.top where t.up in (select page from t)) "
    "select page, cast(max(d) as bigint) as masters, arg_max(top, d) as base from m group by page",
)
def master_pages(spark, sf_dir):
    pages = _t(spark, sf_dir, "part").selectExpr("p_partkey as node", "if(p_partkey > 0, p_partkey div 5, null) as parent")
    return layout.master_chain(pages).withColumnRenamed("node", "page")


@query("J18_layers", "select o_orderkey, n_nationkey - 1 as z, coalesce(n_regionkey < 3, false) as visible from orders left join nation on n_nationkey = o_orderkey % 30")
def layers(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 30).alias("layer"))
    table = F.broadcast(_t(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") - 1).alias("z"), (F.col("n_regionkey") < 3).alias("visible")))  # a fixed table of 25 rows
    return lookup.looked_up(orders, table, {"layer": "n_nationkey"}, {"z": None, "visible": False}).drop("layer")


@query("J19_first_font", "select c_custkey, p_partkey as font from customer join (select p_size, min(p_partkey) as p_partkey from part group by p_size) on p_size = c_custkey % 60")
def first_font(spark, sf_dir):
    customer, part = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "part")
    fonts = part.groupBy("p_size").agg(F.min("p_partkey").alias("font"))
    return layout.first_match(customer.select("c_custkey"), fonts, F.col("c_custkey") % 60 == F.col("p_size"), ["c_custkey"], ["font"]).select("c_custkey", "font")


@query("J22_alternate_names", "select p_partkey, coalesce(a.s_suppkey, b.s_suppkey) as found from part left join supplier a on a.s_suppkey = p_partkey left join supplier b on b.s_suppkey = p_partkey % 200")
def alternate_names(spark, sf_dir):
    names = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("file"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 200).alias("other"))
    return lookup.first_found(rows, [(names, "s_suppkey", "file", "p_partkey"), (names, "s_suppkey", "file", "other")], "found").drop("other")


@query("J24_tag_rules", "select p_partkey, coalesce(a.n_name, b.r_name, 'span') as rule from part left join nation a on a.n_nationkey = p_size left join region b on b.r_regionkey = p_size % 10")
def tag_rules(spark, sf_dir):
    nation, region = F.broadcast(_t(spark, sf_dir, "nation")), F.broadcast(_t(spark, sf_dir, "region"))  # 25 and 5 rows
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("tag"), (F.col("p_size") % 10).alias("group"))
    return lookup.first_found(rows, [(nation, "n_nationkey", "n_name", "tag"), (region, "r_regionkey", "r_name", "group")], "rule", "span").select("p_partkey", "rule")
