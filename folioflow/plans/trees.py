"""Queries of trees that are rebuilt."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import emit, reparent, tagging
from folioflow.plans.layouts import _tag
from folioflow.plans.sources import _joined, _member, _t
from folioflow.registry import query
from folioflow.sources import xml
from folioflow.streaming import lifecycle


@query(
    "P26_rebuilt_trees",
    """with t as (select conv_id, turn, role, turn // 4 as s, turn // 2 as h from conversations),
    p as (select conv_id, s, arg_min(role, turn) as role, min(turn) as t0, '<p class="' || string_agg(role, ' ' order by turn) || '">' || string_agg(turn || role, '' order by turn) || '</p>' as html from t group by conv_id, s, h),
    d as (select conv_id, s, role, min(turn) as t0 from t group by all), dh as (select d.conv_id, d.s, d.t0, '<div class="' || d.role || '">' || coalesce(string_agg(p.html, '' order by p.t0), '') || '</div>' as html from d left join p on p.conv_id = d.conv_id and p.s = d.s and p.role = d.role group by d.conv_id, d.s, d.t0, d.role),
    sh as (select conv_id, s, '<section class="s' || s || '">' || string_agg(html, '' order by t0) || '</section>' as html from dh group by conv_id, s) select conv_id::varchar as path, '<body class="all">' || string_agg(html, '' order by s) || '</body>' as html from sh group by conv_id""",
)
def rebuilt_trees(spark, sf_dir):
    """Each turn names its place: a section for every four turns, in it a division for each role; two turns share a paragraph."""
    rows = _t(spark, sf_dir, "conversations").selectExpr("cast(conv_id as string) as path", "turn", "role", "cast(turn div 4 as string) as s", "cast(turn div 2 as string) as h")
    place = F.concat(F.lit("body.all section.s"), "s", F.lit("#s"), "s", F.lit(" div."), "role", F.lit("#d"), "s", "role")
    turn = _tag("q", F.concat(F.col("turn").cast("string"), "role"), **{reparent.PARENTS: place, reparent.TAG: "p", reparent.HASH: F.concat(F.lit("t"), "h"), reparent.CLASS: F.col("role")})
    docs = rows.groupBy("path").agg(_joined("turn", turn).alias("xml"))
    tree = reparent.rebuilt(xml.nodes(_member(docs, "page", F.concat(F.lit("<x>"), "xml", F.lit("</x>")))), ["path"])
    return emit.serialized(reparent.in_preorder(tree, ["path"]), ["path"])


_GRAMMAR = [("chapter", [], ["list", "p", "note"], [], False), ("list", [], ["li"], [], True), ("li", ["list"], [], [], False), ("p", [], [], [], False), ("note", [], [], ["title"], False), ("title", ["note"], [], [], False)]


@query(
    "P23_tagged_paths",
    """with g as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over w as c, case when count(*) filter (event_type = 'error') over w > 0 then 'backmatter' else 'bodymatter' end as m, max(case when event_type = 'signup' then event_id end) over w as up from events window w as (partition by user_id order by event_id))
    select user_id, event_id as node, case event_type when 'signup' then 'chapter' when 'click' then 'li' when 'view' then 'p' else 'title' end as tag, case when event_type = 'view' then 'lead' end as class, 'n' || event_id as hash,
      'body.' || m || '#b-' || m || ' section.chapter#c-' || m || ' section.' || m || '#m-' || m || case when event_type = 'signup' or up is null then '' else ' chapter#n' || up end || case event_type when 'click' then ' list#' || case when up is null then 'n' || event_id || '-0' else 's' || up || '.list' end when 'purchase' then ' note#n' || event_id || '-0' else '' end as parents,
      event_type = 'signup' and exists (select 1 from g h where h.user_id = g.user_id and h.up = g.event_id and h.event_type in ('click', 'view', 'purchase')) as container from g where event_type <> 'error'""",
)
def tagged_paths(spark, sf_dir):
    """Users' events as marks: a signup begins a chapter with what follows, clicks are items without their list, purchases titles without their note, and an error begins the back matter."""
    from pyspark.sql import Window

    rows = _t(spark, sf_dir, "events")
    up = F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(Window.partitionBy("user_id").orderBy("event_id"))
    marks = F.create_map(*(F.lit(x) for kv in {"signup": "XMLTag/chapter", "click": "XMLTag/li", "view": "XMLTag/p.lead", "purchase": "XMLTag/title", "error": "XMLTag/section.backmatter"}.items() for x in kv))
    nodes = rows.select("user_id", F.col("event_id").alias("node"), F.when(F.col("event_type") != "signup", up).alias("parent"), F.element_at(marks, F.col("event_type")).alias("mark"))
    return tagging.placed(nodes, spark.createDataFrame(_GRAMMAR, tagging.GRAMMAR), ["user_id"])


@query(
    "P33_page_lifecycle",
    """with e as (select *, lag(ts) over w as before from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(case when before is null or ts - before > interval 86400 seconds then 1 else 0 end) over (partition by user_id order by ts, event_id) as s from e),
    b as (select *, coalesce(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, s order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as b, count(*) filter (event_type = 'error') over (partition by user_id, s) as breaks from s),
    p as (select user_id, s, b, min(ts) as started, max(ts) as ended, count(*) as parts, case when b < any_value(breaks) then 'break' else 'gap' end as closed, string_agg(event_id::varchar, '' order by ts, event_id) as html from b where event_type <> 'error' group by user_id, s, b)
    select user_id::varchar as book, epoch_us(ended) - epoch_us(started) as lasted, cast(row_number() over (partition by user_id, s order by b) as int) as page_no, cast(parts as int) as parts, closed, html from p""",
)
def page_lifecycle(spark, sf_dir):
    """Users' events as fragments, errors as breaks; a day's silence ends a session."""
    kind = F.when(F.col("event_type") == "error", "break").otherwise("text")
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("book"), "event_id", "ts", kind.alias("kind"), F.when(kind == "text", F.col("event_id").cast("string")).alias("html"))
    return lifecycle.pages(rows, 86400).select("book", F.expr("timestampdiff(microsecond, started, ended)").alias("lasted"), "page_no", "parts", "closed", "html")


@query(
    "P25_books_of_marks",
    """with e as (select conv_id, turn, role, sum(case when role = 'system' then 1 else 0 end) over (partition by conv_id order by turn) as c, max(case when role = 'system' then turn end) over (partition by conv_id order by turn) as up from conversations),
    item as (select conv_id, up, min(turn) as n, '<list>' || string_agg('<li id="pxe-n' || turn || '">' || turn || '</li>', '' order by turn) || '</list>' as html from e where role = 'assistant' group by conv_id, up),
    lead as (select conv_id, up, turn as n, '<p class="lead" id="pxe-n' || turn || '">' || turn || '</p>' as html from e where role = 'user'),
    chap as (select conv_id, up, min(n) as n, '<chapter>' || string_agg(html, '' order by n) || '</chapter>' as html from (select * from item union all select * from lead) group by conv_id, up
      union all select conv_id, up, up, '<chapter id="pxe-n' || up || '">' || up || '</chapter>' from e where up is not null group by conv_id, up having count(*) = 1)
    select conv_id::varchar as path, '<body class="bodymatter"><section class="chapter"><section class="bodymatter">' || string_agg(html, '' order by n) || '</section></section></body>' as html from chap where up is not null group by conv_id""",
)
def books_of_marks(spark, sf_dir):
    """Conversations as marks: placed by the grammar, written as pages of marked elements, and rebuilt from these. A system's turn begins a chapter; assistants' turns are items, whose list the grammar adds."""
    from pyspark.sql import Window

    rows = _t(spark, sf_dir, "conversations")
    up = F.max(F.when(F.col("role") == "system", F.col("turn"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    mark = F.when(F.col("role") == "system", "XMLTag/chapter").when(F.col("role") == "assistant", "XMLTag/li").otherwise("XMLTag/p.lead")
    rows = rows.withColumn("up", up).where("up is not null").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("node"), F.when(F.col("role") != "system", F.col("up")).alias("parent"), mark.alias("mark"))
    placed = tagging.placed(rows, spark.createDataFrame(_GRAMMAR, tagging.GRAMMAR), ["path"])
    pages = tagging.marked(placed.withColumn("text", F.col("node").cast("string")), ["path"], "node")
    tree = reparent.rebuilt(xml.nodes(pages.select("path", F.lit("page").alias("member"), F.encode("html", "UTF-8").alias("content"))), ["path"])
    return emit.serialized(reparent.in_preorder(tree, ["path"]), ["path"])
