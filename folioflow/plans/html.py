"""Queries over raw web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import markup, runs, styles
from folioflow.registry import query


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _matches_sql(pattern: str, groups: dict[str, int], html: str = "html") -> str:
    lists = ", ".join(f"regexp_extract_all({html}, '{pattern}', {i}) as {n}s" for n, i in groups.items())
    out = ", ".join(f"unnest({n}s) as {n}" for n in groups)
    return f"(select page_id, cast(unnest(range(0, len({next(iter(groups))}s))) as bigint) as ord, {out} from (select page_id, {lists} from pages))"


_FLOWING = f"regexp_replace(regexp_replace(regexp_replace(html, '{markup.SILENT}', '', 'g'), '{markup.BREAK}', ' ', 'g'), '{markup.INLINE}', '', 'g')"
#: In the given pages no text and no attribute holds a less-than or greater-than sign of its own, so a plain pattern gives the same blocks.
_BLOCKS = _matches_sql(r"<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>([^<]+)", {"tag": 1, "text": 2}, _FLOWING)
_TAGS = f"(select * from {_matches_sql(markup.TAGS, {'slash': 1, 'tag': 2})} where lower(tag) not in {markup.VOID})"


@query("s_html_blocks", f"select page_id, ord, tag, trim(text, ' ') as text from {_BLOCKS} where trim(text, ' ') <> ''")
def html_blocks(spark, sf_dir):
    return markup.blocks(pages(spark, sf_dir))


@query("A18_headlines", f"select page_id, ord, tag, trim(text, ' ') as text from {_BLOCKS} where tag like 'h_' and trim(text, ' ') <> ''")
def headlines(spark, sf_dir):
    return markup.blocks(pages(spark, sf_dir)).where("tag like 'h_'")


@query("W9_tag_depth", f"select page_id, cast(max(d) as bigint) as deepest, cast(arg_max(d, ord) as bigint) as open_at_end from (select *, sum(case when slash = '' then 1 else -1 end) over (partition by page_id order by ord) as d from {_TAGS}) group by page_id")
def tag_depth(spark, sf_dir):
    rows = runs.depth(markup.tags(pages(spark, sf_dir)), ["page_id"], ["ord"], F.col("slash") == "", F.col("slash") == "/")
    return rows.groupBy("page_id").agg(F.max("depth").alias("deepest"), F.max_by("depth", "ord").alias("open_at_end"))


@query("A16_tag_balance", f"select page_id, lower(tag) as tag, count(*) filter (slash = '') as opened, count(*) filter (slash = '/') as closed from {_TAGS} group by all")
def tag_balance(spark, sf_dir):
    return markup.tags(pages(spark, sf_dir)).groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count_if(F.col("slash") == "").alias("opened"), F.count_if(F.col("slash") == "/").alias("closed"))


@query("W14_generated_ids", f"select page_id, ord, tag, printf('i%03d', row_number() over (partition by page_id order by ord)) as id from {_TAGS} where slash = ''")
def generated_ids(spark, sf_dir):
    rows = runs.numbered(markup.tags(pages(spark, sf_dir)).where("slash = ''"), ["page_id"], ["ord"], "n")
    return rows.select("page_id", "ord", "tag", F.format_string("i%03d", "n").alias("id"))


@query("C6_id_stamping", f"select page_id, count(*) as stamped from {_matches_sql('<([A-Za-z][A-Za-z0-9]*)([^>]*)>', {'tag': 1, 'rest': 2})} where not contains(rest, ' id=') group by page_id")
def id_stamping(spark, sf_dir):
    rows = markup.matches(pages(spark, sf_dir), "<([A-Za-z][A-Za-z0-9]*)([^>]*)>", {"tag": 1, "rest": 2})
    return rows.where(~F.contains("rest", F.lit(" id="))).groupBy("page_id").agg(F.count("*").alias("stamped"))


_LINKS = _matches_sql('href="([^"]*)"', {"href": 1})


@query("J3_link_kinds", f"select page_id, case when regexp_matches(href, '^[a-z]+://') then 'external' when starts_with(href, '#') then 'anchor' else 'page' end as kind, count(*) as n from {_LINKS} group by all")
def link_kinds(spark, sf_dir):
    kind = F.when(F.col("href").rlike("^[a-z]+://"), "external").when(F.startswith("href", F.lit("#")), "anchor").otherwise("page")
    return markup.links(pages(spark, sf_dir)).groupBy("page_id", kind.alias("kind")).agg(F.count("*").alias("n"))


_RULE = "([a-z.#][^{}]*[{][^}]*[}])"
_RULES = f"""(select page_id, trim(unnest(regexp_extract_all(regexp_extract(html, '(?s)<style>(.*?)</style>', 1), '{_RULE}', 1)), ' ') as rule from pages)"""


@query("A5_css_rules", f"select rule, md5(rule) as sig, min(page_id) as first_page, count(*) as uses from {_RULES} group by rule")
def css_rules(spark, sf_dir):
    # rules are looked for in the style element alone: over a whole page the pattern takes quadratic time
    sheets = pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "(?s)<style>(.*?)</style>", 1).alias("html"))
    rules = markup.matches(sheets, _RULE, {"rule": 1}).withColumn("rule", F.trim("rule"))
    return rules.groupBy("rule", F.md5(F.col("rule").cast("binary")).alias("sig")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("uses"))


@query("F11_empty_elements", "select page_id, regexp_replace(html, '<(b|span|i)( [^>]*)?>[ ]*</(b|span|i)>', '', 'g') as html from pages")
def empty_elements(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", markup.without_empty_spans(F.col("html")).alias("html"))


@query("A8_font_faces", "select page_id, regexp_replace(replace(html, '<style>', '<style> @font-face {src:url(a.otf)}'), '.@font-face *[{][^}]*[}]', '', 'g') as html from pages")
def font_faces(spark, sf_dir):
    html = F.replace("html", F.lit("<style>"), F.lit("<style> @font-face {src:url(a.otf)}"))
    return pages(spark, sf_dir).select("page_id", markup.without_font_faces(html).alias("html"))


@query("A6_used_tags", f"select page_id, string_agg(tag, ' ' order by tag) as tags from (select distinct page_id, lower(tag) as tag from {_TAGS}) group by page_id")
def used_tags(spark, sf_dir):
    return markup.tags(pages(spark, sf_dir)).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower("tag"))), " ").alias("tags"))


@query("A10_page_text", f"select page_id, string_agg(text, '' order by ord) as text from {_BLOCKS} group by page_id")
def page_text(spark, sf_dir):
    rows = markup.block_rows(pages(spark, sf_dir))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s.text), "").alias("text"))


@query("W4_merged_runs", f"select page_id, cast(run as bigint) as run, any_value(tag) as style, string_agg(text, '' order by ord) as text from (select *, sum(new) over (partition by page_id order by ord) as run from (select *, case when lag(tag) over (partition by page_id order by ord) = tag then 0 else 1 end as new from {_BLOCKS})) group by page_id, run")
def merged_runs(spark, sf_dir):
    rows = markup.block_rows(pages(spark, sf_dir))
    return runs.merged(rows, ["page_id"], ["ord"], F.col("tag"), F.col("text"))


@query("W5_list_groups", f"select page_id, cast(island as bigint) as island, any_value(tag) as tag, count(*) as items from (select *, sum(new) over (partition by page_id order by ord) as island from (select *, case when lag(tag) over (partition by page_id order by ord) = tag then 0 else 1 end as new from {_BLOCKS})) where tag = 'p' group by page_id, island")
def list_groups(spark, sf_dir):
    rows = markup.block_rows(pages(spark, sf_dir))
    return runs.islands(rows, ["page_id"], ["ord"], F.col("tag")).where("tag = 'p'").groupBy("page_id", "island").agg(F.first("tag").alias("tag"), F.count("*").alias("items"))


@query("A4_style_signatures", f"select page_id, sig, 'cls_' || (row_number() over (partition by page_id order by o) - 1) as name, uses from (select page_id, md5('tag:' || tag || ';width:' || w) as sig, min(ord) as o, count(*) as uses from (select *, cast(length(text) % 7 as varchar) as w from {_BLOCKS}) group by page_id, sig)")
def style_signatures(spark, sf_dir):
    rows = markup.block_rows(pages(spark, sf_dir))
    rows = rows.withColumn("sig", styles.signature(F.create_map(F.lit("width"), (F.length("text") % 7).cast("string"), F.lit("tag"), F.col("tag"), F.lit("color"), F.lit(""))))
    return styles.deduplicated(rows, ["page_id"], ["ord"], "sig").select("page_id", "sig", "name", "uses")
