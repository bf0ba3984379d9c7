"""Queries of Word bodies: a document for every 48 parts, a paragraph or row for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.plans.layouts import _tag
from folioflow.plans.sources import _joined, _member, _t
from folioflow.registry import query
from folioflow.sources import docx

_W = 'xmlns:w="urn:w"'
_NUMBERING = f'<w:numbering {_W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="2"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="4"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
_STYLES = f'<w:styles {_W}><w:style w:type="paragraph" w:styleId="A"><w:pPr><w:numPr><w:numId w:val="4"/></w:numPr></w:pPr></w:style><w:style w:type="paragraph" w:styleId="B"><w:basedOn w:val="A"/></w:style></w:styles>'
_K = "k as (select p_partkey // 48 as d, p_partkey as k from part)"


def _rows(spark, sf_dir):
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(F.floor(k / 48).cast("string").alias("path"), k.alias("k"), k.cast("string").alias("t"))


def _docs(rows, content, inside: str = ""):
    """The members of a document for each path, whose body holds ``content`` of its rows in order."""
    docs = rows.groupBy("path").agg(_joined("k", content).alias("xml"))
    start, end = (f"<w:{inside}>", f"</w:{inside}>") if inside else ("", "")
    document = F.concat(F.lit(f"<w:document {_W}><w:body>{start}"), "xml", F.lit(f"{end}</w:body></w:document>"))
    return _member(docs, "word/document.xml", document).union(_member(docs, "word/styles.xml", F.lit(_STYLES))).union(_member(docs, "word/numbering.xml", F.lit(_NUMBERING)))


def _run(text):
    return F.concat(F.lit("<w:r><w:t>"), text, F.lit("</w:t></w:r>"))


@query(
    "P8_nested_lists",
    f"""with {_K}, g as (select d, k // 4 as g, '<li>' || max(k) filter (k % 4 = 0) || '<ol><li>' || max(k) filter (k % 4 = 1) || '<ul><li>' || max(k) filter (k % 4 = 2) || '</li></ul></li><li>' || max(k) filter (k % 4 = 3) || '</li></ol></li>' as html from k group by d, k // 4)
    select d::varchar as path, '<ul>' || string_agg(html, '' order by g) || '</ul>' as html from g group by d""",
)
def nested_lists(spark, sf_dir):
    """Items of the levels 0, 1, 2, 1."""
    level = F.get(F.array(*map(F.lit, ("0", "1", "2", "1"))), F.col("k") % 4)
    numbered = F.concat(F.lit('<w:pPr><w:numPr><w:ilvl w:val="'), level, F.lit('"/><w:numId w:val="4"/></w:numPr></w:pPr>'))
    return docx.body_blocks(_docs(_rows(spark, sf_dir), _tag("w:p", F.concat(numbered, _run(F.col("t")))))).select("path", "html")


@query(
    "P12_style_lists",
    f"""with {_K}, g as (select d, k // 4 as g, '<p>' || max(k) filter (k % 4 = 0) || '</p><ul><li>' || max(k) filter (k % 4 = 1) || '</li><li>' || max(k) filter (k % 4 = 2) || '</li></ul><p>' || max(k) filter (k % 4 = 3) || '</p>' as html from k group by d, k // 4)
    select d::varchar as path, 1::bigint as page_no, string_agg(html, '' order by g) as html from g group by d""",
)
def style_lists(spark, sf_dir):
    """Paragraphs without a numbering, with that of their style, with that of the style it is based on, and with the style's switched off."""
    said = [F.lit(""), *(F.lit(f'<w:pPr><w:pStyle w:val="{s}"/>{n}</w:pPr>') for s, n in (("A", ""), ("B", ""), ("A", '<w:numPr><w:numId w:val="0"/></w:numPr>')))]
    rows = _docs(_rows(spark, sf_dir), _tag("w:p", F.concat(F.get(F.array(*said), F.col("k") % 4), _run(F.col("t")))))
    return docx.body_pages(rows).select("path", "page_no", "html")


@query(
    "P9_merged_cells",
    f"""with {_K}, m as (select *, count(*) over (partition by d, k // 3) as n from k)
    select d::varchar as path, '<table><tbody>' || string_agg('<tr>' || case when k % 3 = 0 then '<td' || case when n > 1 then ' rowspan="' || n || '"' else '' end || '>' || k || '</td>' else '' end || case when k % 2 = 0 then '<td colspan="2">w</td>' else '<td>x</td><td>y</td>' end || '<td style="background-color:#00FF00">z</td></tr>', '' order by k) || '</tbody></table>' as html from m group by d""",
)
def merged_cells(spark, sf_dir):
    """Rows of which three share their first cell; in every other row a cell is two columns wide."""
    cell = lambda text, props="": F.concat(F.lit("<w:tc><w:tcPr>"), F.lit(props) if isinstance(props, str) else props, F.lit("</w:tcPr><w:p>"), _run(text), F.lit("</w:p></w:tc>"))
    first = cell(F.col("t"), F.when(F.col("k") % 3 == 0, '<w:vMerge w:val="restart"/>').otherwise("<w:vMerge/>"))
    middle = F.when(F.col("k") % 2 == 0, cell(F.lit("w"), '<w:gridSpan w:val="2"/>')).otherwise(F.concat(cell(F.lit("x")), cell(F.lit("y"))))
    rows = _docs(_rows(spark, sf_dir), F.concat(F.lit("<w:tr>"), first, middle, cell(F.lit("z"), '<w:shd w:fill="00FF00"/>'), F.lit("</w:tr>")), "tbl")
    tree = docx.body(rows)
    return docx.body_tables(rows, docx.body_paragraphs(rows, tree), tree).select("path", "html")


@query(
    "P10_drop_downs",
    f"""with {_K} select d::varchar as path, 1::bigint as page_no, string_agg('<p>' || k || '<select><option value="0"' || case when k % 3 = 0 then ' selected="selected"' else '' end || '>a &amp; b</option><option value="1"' || case when k % 3 = 1 then ' selected="selected"' else '' end || '>c' || k || '</option></select></p>', '' order by k) as html from k group by d""",
)
def drop_downs(spark, sf_dir):
    """A control with two entries in each paragraph, of which one, the other or none is shown."""
    item = lambda name, value: F.concat(F.lit('<w:listItem w:displayText="'), name, F.lit(f'" w:value="{value}"/>'))
    other = F.concat(F.lit("c"), "t")
    shown = F.when(F.col("k") % 3 == 0, "a &amp; b").when(F.col("k") % 3 == 1, other).otherwise("?")
    control = F.concat(F.lit("<w:sdt><w:sdtPr><w:dropDownList>"), item(F.lit("a &amp; b"), 0), item(other, 1), F.lit("</w:dropDownList></w:sdtPr><w:sdtContent>"), _run(shown), F.lit("</w:sdtContent></w:sdt>"))
    rows = _docs(_rows(spark, sf_dir), _tag("w:p", F.concat(_run(F.col("t")), control)))
    return docx.body_pages(rows).select("path", "page_no", "html")


@query(
    "P17_word_links",
    f"""with {_K}, a as (select *, case when k % 2 = 0 then '<a href="http://x.y/?a=1&amp;b=' || k || '">' else '<a href="#p' || k || '">' end as a from k)
    select d::varchar as path, 1::bigint as page_no, string_agg('<p>' || a || k || '</a>' || a || '<span style="font-weight:bold">!</span></a></p>', '' order by k) as html from a group by d""",
)
def word_links(spark, sf_dir):
    """Links to other places, through a document's relationships, and to places in it; each has a plain and a bold run."""
    rows = _rows(spark, sf_dir)
    runs = F.concat(_run(F.col("t")), F.lit("<w:r><w:rPr><w:b/></w:rPr><w:t>!</w:t></w:r>"))
    link = F.when(F.col("k") % 2 == 0, F.concat(F.lit('<w:hyperlink r:id="r'), "t", F.lit('">'))).otherwise(F.concat(F.lit('<w:hyperlink w:anchor="p'), "t", F.lit('">')))
    body = _docs(rows, _tag("w:p", F.concat(link, runs, F.lit("</w:hyperlink>"))))
    # the prefix of relationships is declared where the document is
    body = body.withColumn("content", F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("<w:document "), F.lit('<w:document xmlns:r="urn:r" ')), "UTF-8"))
    rel = F.concat(F.lit('<Relationship Id="r'), "t", F.lit('" Type="h" Target="http://x.y/?a=1&amp;b='), "t", F.lit('"/>'))
    rels = rows.where("k % 2 = 0").groupBy("path").agg(_joined("k", rel).alias("xml"))
    body = body.union(_member(rels, "word/_rels/document.xml.rels", F.concat(F.lit("<Relationships>"), "xml", F.lit("</Relationships>"))))
    return docx.body_pages(body).select("path", "page_no", "html")


@query(
    "S29_paragraph_properties",
    f"""with {_K} select d::varchar as path, 'S' || k as style, case when k % 48 > 0 then 'S' || (k - 1) end as based_on, 'margin-top:' || cast(round(k / 11.0::double) as int) || 'px;margin-bottom:0px' || case when k % 3 = 0 then ';text-align:justify' when k % 3 = 1 then ';text-align:right' else '' end || ';text-indent:' || cast(round(case when k % 2 = 0 then 110 else k end / 11.0::double) as int) || 'px' as css from k""",
)
def paragraph_properties(spark, sf_dir):
    """Styles with spacing, alignment and indents, where a first line's indent of 0 is the left one."""
    rows = _rows(spark, sf_dir)
    based = F.when(F.col("k") % 48 > 0, F.concat(F.lit('<w:basedOn w:val="S'), (F.col("k") - 1).cast("string"), F.lit('"/>'))).otherwise("")
    props = F.concat(
        F.lit('<w:pPr><w:spacing w:before="'), "t", F.lit('" w:after="0"/>'), F.when(F.col("k") % 3 == 0, '<w:jc w:val="both"/>').when(F.col("k") % 3 == 1, '<w:jc w:val="end"/>').otherwise(""),
        F.lit('<w:ind w:left="'), F.when(F.col("k") % 2 == 0, "110").otherwise(F.col("t")), F.lit('" w:firstLine="0"/></w:pPr>'),
    )
    style = F.concat(F.lit('<w:style w:type="paragraph" w:styleId="S'), "t", F.lit('">'), based, props, F.lit("</w:style>"))
    docs = rows.groupBy("path").agg(_joined("k", style).alias("xml"))
    return docx.style_properties(_member(docs, "word/styles.xml", F.concat(F.lit(f"<w:styles {_W}>"), "xml", F.lit("</w:styles>"))))
