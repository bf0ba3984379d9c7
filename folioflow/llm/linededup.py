"""Line deduplication by overlapping windows of three lines.

A window is three consecutive non-blank lines of a document, compared without the
white space at their ends. The first occurrence of a window in the whole corpus, by
``doc_id`` and then by position, stays; a line is removed if a later occurrence of a
repeated window covers it. Where a later occurrence overlaps the first one in the same
document, it covers only the lines beyond it. A blank line goes if it lies inside a removed window; others stay.

Hashes are two independent 64-bit values. Everything is DataFrame expressions: windows
are made inside each row, counted with partial aggregation, and matched to the repeated
ones by a join of two written sides, which Spark can split for a hot window. Only one
document's own covered positions are ever collected together.

Null texts stay null; texts of fewer than three lines are left as they are. Rows equal in
id and text count as one document: they are treated alike. Rows without an id come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import own, table, written

SIZE = 3
_KEYED = "struct(isnull(doc_id) as no_id, doc_id as id, text_key, p0, p2)"


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, p0, p2, wa, wb: the first and last line number and the hash of each window."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n", -1).alias("lines"))
    lines = F.expr("filter(transform(lines, (l, i) -> struct(i, trim(BOTH ' \t\r' FROM l) as l)), x -> x.l <> '')")
    hashed = F.expr("transform(lines, x -> struct(x.i, xxhash64(x.l) as a, xxhash64(1, x.l) as b))")
    rows = rows.select("doc_id", "text_key", lines.alias("lines")).where(F.size("lines") >= SIZE).select("doc_id", "text_key", hashed.alias("h"))
    three = F.expr("transform(sequence(0, size(h) - 3), i -> struct(h[i].i as p0, h[i + 2].i as p2, xxhash64(h[i].a, h[i + 1].a, h[i + 2].a) as wa, xxhash64(h[i].b, h[i + 1].b, h[i + 2].b) as wb))")
    return rows.select("doc_id", "text_key", F.inline(three))


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, gone: the numbers of the lines to remove, for documents that have any."""
    every = windows(docs)
    repeated = every.groupBy("wa", "wb").agg(F.expr(f"min({_KEYED})").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = written(repeated.select("wa", "wb", "first"))
    later = every.join(repeated, ["wa", "wb"]).withColumn("own", F.expr("doc_id <=> first.id and text_key = first.text_key"))
    later = later.select("doc_id", "text_key", F.expr("if(own, greatest(p0, if(p0 <= first.p2, first.p2 + 1, p0)), p0)").alias("lo"), F.col("p2").alias("hi")).where("lo <= hi and not (own and hi <= first.p2)")
    spans = later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return spans.select("doc_id", "text_key", F.expr("array_distinct(flatten(transform(spans, s -> sequence(s.lo, s.hi))))").alias("gone"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """own (a struct of the row), text, n_lines and removed for each row of ``docs``; ``text`` without later occurrences."""
    gone = written(covered(docs)).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "gone")
    keyed = docs.select(own(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    # always by a shuffle, so that a run behaves alike at every size
    out = keyed.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    joined = F.transform(F.array(F.struct(lines.alias("l"), kept.alias("k"))), lambda s: F.array_join(F.transform(s.k, lambda i: F.get(s.l, i)), "\n"))[0]
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(joined)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return out.select("own", text.alias("text"), n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with later occurrences removed from ``text``; a column ``n_chars`` follows a changed text."""
    out = deduplicated(docs)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("own.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"own.`{c}`") for c in docs.columns))


def op4_line_windows(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, removed and the text that stays, for all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("own.doc_id", "n_lines", "removed", "text")


SQL = r"""
with l as (
  select doc_id, i - 1 as i, trim(l, ' ' || chr(9) || chr(13)) as l
  from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)
), w as (
  select doc_id, i as p0, lead(i, 2) over o as p2, l || chr(10) || lead(l, 1) over o || chr(10) || lead(l, 2) over o as w
  from l where l <> '' window o as (partition by doc_id order by i)
), f as (
  select *, first_value(doc_id) over o as fd, first_value(p2) over o as f2, row_number() over o as n
  from w where w is not null window o as (partition by w order by doc_id, p0)
), c as (
  select doc_id, case when fd = doc_id and p0 <= f2 then f2 + 1 else p0 end as lo, p2 as hi from f where n > 1
), g as (
  select distinct doc_id, unnest(range(lo, hi + 1)) as i from c where lo <= hi
), k as (
  select d.doc_id, d.i, d.l, g.i as gone
  from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(0, len(string_split(text, chr(10))))) as i from documents) d
  left join g on g.doc_id = d.doc_id and g.i = d.i
)
select doc_id, count(*) as n_lines, count(gone) as removed, coalesce(string_agg(l, chr(10) order by i) filter (gone is null), '') as text
from k group by doc_id
"""
