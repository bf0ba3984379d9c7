"""Queries of filters and of style ancestry."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import decoders
from folioflow.operators import filters, styles
from folioflow.plans.scalars import _PART, _choose, _pick, c, scalar
from folioflow.registry import query

_TAGS = ["Rectangle", "Br", "Metadata", "Oval", "Link"]
scalar("F3_parsable", _PART, lambda: filters.parsable(_choose(_TAGS)), f"{_pick(_TAGS)} not in ('Metadata', 'Link')")
scalar("F15_in_story", _PART, lambda: filters.in_story(_choose(["XMLElement", "Group"]), _choose(["u1", "u2", ""], "b"), F.lit("u1")), "a % 2 = 1 or b % 3 <> 1")
scalar("F23_has_value", _PART, lambda: filters.has_value(F.create_map(F.lit("tag"), F.when(c("n") % 3 > 0, c("brand")).otherwise(""), F.lit("other"), c("name")), "tag"), "n % 3 > 0")
scalar("F25_positioned", _PART, lambda: filters.positioned(F.when(c("n") % 3 > 0, c("n") % 3 == 1), c("a") % 2 == 0, c("b") % 2 == 0), "(n % 3 = 1 or b % 2 = 0) and a % 2 = 1")
scalar("P15_frame_tag", _PART, lambda: filters.frame_tag(c("a") % 2 == 0, c("b") % 3 == 0), "case when b % 3 = 0 then 'span' when a % 2 = 0 then 'aside' else 'section' end")
scalar("P22_instruction", _PART, lambda: filters.instruction(c("n"), c("brand"), c("a") % 2 == 0), "case when n = 18 and a % 2 = 0 then brand else '' end")
scalar("K13_crop", _PART, lambda: filters.crop(c("price"), c("n")), "round(price * n / 72.0::double)")


@query("F2_checked_type", "select p_partkey, p_size % 3 = 0 as checked from part")
def checked_type(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("kind", F.get(F.array(F.lit("idml"), F.lit("epub"), F.lit(None)), F.col("p_size") % 3))
    right = filters.checked_type(part.where(F.col("kind") == "idml"), F.col("kind"), "idml").select("p_partkey", F.lit(True).alias("checked"))
    return right.union(part.where("kind is null or kind <> 'idml'").select("p_partkey", filters.is_type(F.col("kind"), "idml")))


@query("F26_children", "select o_custkey as parent_id, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as children, max(o_orderkey) as last from orders where o_orderstatus = 'O' group by o_custkey")
def children(spark, sf_dir):
    nodes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(1).alias("path"), F.col("o_custkey").alias("parent_id"), F.col("o_orderkey").alias("node_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("tag"))
    rows = filters.children(nodes, ["path"], "O")
    return rows.select("parent_id", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"), "last")


@query("F27_tagged_books", "select c_nationkey as path, bool_or(c_custkey % 20 = 0) as tagged from customer group by c_nationkey")
def tagged_books(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    tag = F.when(F.col("c_custkey") % 20 == 0, "XMLTag/pxe").otherwise("XMLTag/p")
    return filters.tagged_books(customer.select(F.col("c_nationkey").alias("path"), F.create_map(F.lit("MarkupTag"), tag).alias("attrs")))


@query(
    "D37_style_ancestry",
    """with recursive t as (select p_partkey as node, case when p_partkey > 0 then p_partkey // 3 end as parent, case when p_size % 3 > 0 then p_brand end as style from part),
    w as (select node, parent, case when style is null then '' else style || ' ' end as styles from t union all select w.node, t.parent, w.styles || case when t.style is null then '' else t.style || ' ' end from w join t on t.node = w.parent) select node, rtrim(styles, ' ') as styles from w where parent is null""",
)
def style_ancestry(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    nodes = part.select(key.alias("node"), F.when(key > 0, F.floor(key / 3)).alias("parent"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("style"))
    return styles.ancestry(nodes).select("node", F.array_join("styles", " ").alias("styles"))


@query(
    "D1_decoded_styles",
    """with recursive t as (select p_partkey as style, case when p_partkey > 0 then p_partkey // 5 end as up, p_size as n from part), w as (select style, style as here, 0 as d from t union all select w.style, t.up, d + 1 from w join t on t.style = w.here where t.up in (select style from t)),
    p as (select w.style, d, unnest(['Opacity', 'Tracking', 'FirstLineIndent', 'Hyphenation']) as k, unnest([case when n % 3 = 0 then n::varchar end, case when n % 4 = 0 then n::varchar end, case when n % 5 = 0 then (n / 4.0::double)::varchar end, case when n % 2 = 0 then 'false' end]) as v from w join t on t.style = w.here),
    b as (select style, k, arg_min(v, d) as v from p where v is not null group by all), s as (select style, max(v) filter (k = 'Opacity') as o, max(v) filter (k = 'Tracking') as t, max(v) filter (k = 'FirstLineIndent') as f, max(v) filter (k = 'Hyphenation') as h from b group by style)
    select style, concat_ws(';', 'letter-spacing:' || regexp_replace(cast(t::double / 1000.0::double as varchar), '[.]0$', '') || 'em', 'text-indent:' || regexp_replace(cast(round(f::double, 1) as varchar), '[.]0$', '') || 'px', case when h = 'false' then '-webkit-hyphens:none' end, 'opacity:' || regexp_replace(cast(round(o::double / 100.0::double, 1) as varchar), '[.]0$', '')) as css from s""",
)
def decoded_styles(spark, sf_dir):
    pairs = "map('TransparencySetting::BlendingSetting->Opacity', if(p_size % 3 = 0, cast(p_size as string), null), 'Tracking', if(p_size % 4 = 0, cast(p_size as string), null), 'FirstLineIndent', if(p_size % 5 = 0, cast(cast(p_size as double) / 4 as string), null), 'Hyphenation', if(p_size % 2 = 0, 'false', null))"
    declared = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as style", "if(p_partkey > 0, p_partkey div 5, null) as based_on", f"map_filter({pairs}, (k, v) -> v is not null) as props")
    return decoders.rules(styles.flattened(declared), [], "style", "props")
