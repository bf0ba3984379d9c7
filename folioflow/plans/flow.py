"""Queries of counters, splits and neighbours, over tables with an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import css
from folioflow.operators import lookup, markup, runs
from folioflow.registry import query


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")


_W = "(partition by user_id order by event_id)"
_KEYS, _ORDER = ["user_id"], ["event_id"]


@query("W6_page_split", f"select user_id, event_id, cast(sum(case when event_type = 'signup' then 1 else 0 end) over {_W} as bigint) as page from events")
def page_split(spark, sf_dir):
    return runs.split_at(events(spark, sf_dir), _KEYS, _ORDER, F.col("event_type") == "signup").select("user_id", "event_id", "page")


@query("W1_list_numbers", f"select user_id, event_id, row_number() over (partition by user_id, l order by event_id) - 1 + case when l = 0 then 1 else first_value(event_id % 5) over (partition by user_id, l order by event_id) end as number from (select *, sum(case when event_type = 'signup' then 1 else 0 end) over {_W} as l from events)")
def list_numbers(spark, sf_dir):
    return runs.list_numbers(events(spark, sf_dir), _KEYS, _ORDER, F.col("event_type") == "signup", F.col("event_id") % 5).select("user_id", "event_id", "number")


@query(
    "W2_section_numbers",
    f"""with l as (select *, case event_type when 'signup' then 0 when 'view' then 1 else 2 end as lv from events), g as (select *, sum(case when lv = 0 then 1 else 0 end) over {_W} as g from l),
    n as (select *, sum(case when lv = 1 then 1 else 0 end) over (partition by user_id, g order by event_id) as n from g), m as (select *, sum(case when lv > 1 then 1 else 0 end) over (partition by user_id, g, n order by event_id) as m from n)
    select user_id, event_id, case lv when 0 then g::varchar when 1 then g || '.' || n else g || '.' || n || '.' || m end as section from m""",
)
def section_numbers(spark, sf_dir):
    level = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return runs.section_numbers(events(spark, sf_dir), _KEYS, _ORDER, level).select("user_id", "event_id", "section")


@query(
    "W8_row_roles",
    f"with n as (select *, row_number() over {_W} as n, count(*) over (partition by user_id) as c from events), r as (select *, case when n <= 1 then 'header' when n > c - 1 then 'footer' else 'body' end as role from n) select user_id, event_id, role, n = min(n) over (partition by user_id, role) as opens, n = max(n) over (partition by user_id, role) as closes from r",
)
def row_roles(spark, sf_dir):
    return runs.row_roles(events(spark, sf_dir), _KEYS, _ORDER, 1, 1).select("user_id", "event_id", "role", "opens", "closes")


@query("W10_banding", f"select user_id, event_id, case when row_number() over {_W} = 1 then 'firstRow' when row_number() over (partition by user_id order by event_id desc) = 1 then 'lastRow' when (row_number() over {_W} - 1) % 2 = 0 then 'band2Horz' else 'band1Horz' end as band from events")
def banding(spark, sf_dir):
    return runs.banding(events(spark, sf_dir), _KEYS, _ORDER).select("user_id", "event_id", "band")


@query("W11_tab_widths", f"select user_id, event_id, cast(event_id - coalesce(lag(event_id) over {_W}, 0) as double) as width, lead(event_id) over {_W} as next_stop from events")
def tab_widths(spark, sf_dir):
    return runs.tab_widths(events(spark, sf_dir), _KEYS, _ORDER, "event_id").select("user_id", "event_id", "width", "next_stop")


@query("W13_z_order", f"select user_id, event_id, row_number() over {_W} - 1 as z from events")
def z_order(spark, sf_dir):
    return runs.numbered(events(spark, sf_dir), _KEYS, _ORDER, "z", 0).select("user_id", "event_id", F.col("z").cast("long").alias("z"))


@query("W15_heading_ids", f"select user_id, event_id, '#toc' || (row_number() over {_W} - 1) as row_id, row_number() over {_W} - 2 as heading_id from events where event_type = 'signup'")
def heading_ids(spark, sf_dir):
    rows = runs.numbered(events(spark, sf_dir).where("event_type = 'signup'"), _KEYS, _ORDER, "n", 0)
    return rows.select("user_id", "event_id", F.concat(F.lit("#toc"), F.col("n").cast("string")).alias("row_id"), (F.col("n") - 1).cast("long").alias("heading_id"))


@query("W17_page_numbers", "select page_id, row_number() over (partition by split_part(url, '/', 3) order by url, page_id) + 9 as page_no from pages")
def page_numbers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("host", F.split_part("url", F.lit("/"), F.lit(3)))
    return runs.numbered(rows, ["host"], ["url", "page_id"], "page_no", 10).select("page_id", F.col("page_no").cast("long").alias("page_no"))


@query("W18_toc_entries", "select conv_id, t[1] as number, case when len(t) > 1 then t[len(t) - 1] end as page, array_to_string(list_filter(t, lambda x, i: i > 1 and i <> len(t) - 1), ' ') as description from (select conv_id, list(role || turn order by turn) as t from conversations group by conv_id)")
def toc_entries(spark, sf_dir):
    rows = lookup.gathered(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id"], "turn", F.concat("role", F.col("turn").cast("string")), "cells")
    return rows.select("conv_id", markup.toc_parts(F.col("cells")).alias("t")).select("conv_id", "t.number", "t.page", "t.description")


@query("W19_indentation", "select p_partkey, case when p_size = 18 then 0 else cast(round((p_size - 18) / 9.0::double + 2) as int) end as em, cast(trunc(p_partkey / nullif(p_size % 4, 0) / 4.0::double * 100) as bigint) as px from part")
def indentation(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", css.indent_em(F.col("p_size")).alias("em"), css.indent_px(F.col("p_partkey"), F.col("p_size") % 4).alias("px"))


@query("O4_first_only", "select user_id, arg_min(event_type, event_id) as first_type from events group by user_id")
def first_only(spark, sf_dir):
    return lookup.first_of(events(spark, sf_dir).withColumn("first_type", F.col("event_type")), ["user_id"], ["event_id"], ["first_type"])


@query("A15_child_counts", "select user_id, count(*) filter (event_type = 'view') as views, count(*) filter (event_type = 'click') as clicks, count(*) as children from events group by user_id")
def child_counts(spark, sf_dir):
    return lookup.child_counts(events(spark, sf_dir), ["user_id"], "event_type", {"view": "views", "click": "clicks"})


@query("A9_first_dimensions", "select user_id, arg_min(event_id, event_id) filter (event_type = 'purchase') as first_id from events group by user_id")
def first_dimensions(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("first_id", F.col("event_id"))
    return lookup.first_of(rows, ["user_id"], ["event_id"], ["first_id"], F.col("event_type") == "purchase")


@query("A13_repeated_keys", "select user_id, event_type, string_agg(event_id::varchar, ',' order by event_id) as ids from events group by user_id, event_type")
def repeated_keys(spark, sf_dir):
    rows = lookup.gathered(events(spark, sf_dir), ["user_id", "event_type"], "event_id", F.col("event_id").cast("string"), "ids")
    return rows.select("user_id", "event_type", F.array_join("ids", ",").alias("ids"))


@query("S31_unique_keys", f"select user_id, event_id, case when n = 1 then event_type else event_type || n end as key from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events)")
def unique_keys(spark, sf_dir):
    rows = runs.numbered(events(spark, sf_dir), ["user_id", "event_type"], _ORDER, "n")
    return rows.select("user_id", "event_id", F.when(F.col("n") == 1, F.col("event_type")).otherwise(F.concat("event_type", F.col("n").cast("string"))).alias("key"))
