"""Nested lists, links, merged cells, table styles, style-level numbering and drop-downs of Word bodies."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import emit
from folioflow.sources import docx, files
from tests.test_sources import W, archive

R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def brute_lists(items):
    """Markup of nested lists by recursion: (level, tag, html) in order."""

    def part(rows):
        out, i = "", 0
        open_ = None
        while i < len(rows):
            level, tag, html = rows[i]
            j = i + 1
            while j < len(rows) and rows[j][0] > level:
                j += 1
            if tag != open_:
                out += (f"</{open_}>" if open_ else "") + f"<{tag}>"
                open_ = tag
            out += f"<li>{html}{part(rows[i + 1 : j])}</li>"
            i = j
        return out + (f"</{open_}>" if open_ else "")

    return part(items)


def test_nested_lists_against_recursion(spark):
    r = random.Random(3)
    groups = {g: [(r.choice([0, 0, 1, 1, 2, 3, 8]), r.choice(["ul", "ul", "ol"]), f"i{i}") for i in range(r.randrange(1, 14))] for g in range(60)}
    groups |= {60: [(0, "ul", "a"), (1, "ol", "b"), (0, "ul", "c")], 61: [(2, "ul", "a"), (0, "ul", "b"), (2, "ul", "c"), (1, "ul", "d")]}
    rows = spark.createDataFrame([(g, i, level, tag, html) for g, items in groups.items() for i, (level, tag, html) in enumerate(items)], "g int, p int, level int, tag string, html string")
    got = {x.g: (x.start, x.html) for x in emit.nested_lists(rows, ["g"], "p").collect()}
    assert got == {g: (0, brute_lists(items)) for g, items in groups.items()}
    assert got[60][1] == "<ul><li>a<ol><li>b</li></ol></li><li>c</li></ul>"


def test_levels_that_are_null_or_out_of_range(spark):
    rows = spark.createDataFrame([(1, 1, None, "ul", "a"), (1, 2, 99, "ul", "b"), (1, 3, -4, "ul", "c")], "g int, p int, level int, tag string, html string")
    assert emit.nested_lists(rows, ["g"], "p").first().html == "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"
    assert emit.nested_lists(rows.where("false"), ["g"], "p").count() == 0


def para(text, level=None, num=None, style=None, before="", after=""):
    numbered = f'<w:numPr>{f"<w:ilvl w:val=\"{level}\"/>" if level is not None else ""}<w:numId w:val="{num}"/></w:numPr>' if num is not None else ""
    styled = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{styled}{numbered}</w:pPr>{before}<w:r><w:t>{text}</w:t></w:r>{after}</w:p>"


def cell(text, *props):
    return f'<w:tc><w:tcPr>{"".join(props)}</w:tcPr>{text if text.startswith("<") else para(text)}</w:tc>'


def row(*cells, props=""):
    return f"<w:tr>{props}{''.join(cells)}</w:tr>"


START, GO, WIDE = '<w:vMerge w:val="restart"/>', "<w:vMerge/>", '<w:gridSpan w:val="2"/>'
MERGED = row(cell("a", START), cell("b", WIDE), cell("c")) + row(cell("x", GO), cell("d"), cell("e", START), cell("f", GO)) + row(cell("g", GO), cell("h", WIDE, GO), cell("i"))
STYLED = '<w:tblPr><w:tblStyle w:val="Grid"/></w:tblPr>' + "".join(row(cell(f"r{i}", '<w:shd w:fill="00FF00"/>' if i == 3 else "", '<w:tcW w:w="1510" w:type="dxa"/>' if i == 1 else "")) for i in range(4))
LINK = '<w:hyperlink r:id="rId7"><w:r><w:t>one </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>two</w:t></w:r></w:hyperlink>'
PLACE = '<w:hyperlink w:anchor="top"><w:r><w:t>up</w:t></w:r></w:hyperlink>'
DROP = '<w:sdt><w:sdtPr><w:dropDownList><w:listItem w:displayText="Red" w:value="r"/><w:listItem w:displayText="Blue &amp; co" w:value="b"/></w:dropDownList></w:sdtPr><w:sdtContent><w:r><w:t>Blue </w:t></w:r><w:r><w:t>&amp; co</w:t></w:r></w:sdtContent></w:sdt>'
PARTS = {
    "word/document.xml": f"""<w:document {W} {R}><w:body>{para("zero", 0, 1)}{para("one", 1, 1)}{para("two", 2, 1)}{para("again", 0, 1)}{para("other", 0, 2)}
{para("see ", before="", after=LINK + "<w:r><w:t> and </w:t></w:r>" + PLACE)}{para("by style", style="ListB")}{para("by style too", style="ListC")}{para("no list", num=0, style="ListB")}
<w:tbl>{MERGED}</w:tbl><w:tbl>{STYLED}</w:tbl><w:tbl>{row(cell(para("in ") + para("p", 0, 1) + para("q", 1, 1) + para("r", 0, 1)))}</w:tbl>{para("pick: ", after=DROP)}<w:sdt><w:sdtPr/><w:sdtContent>{para("in a control")}</w:sdtContent></w:sdt></w:body></w:document>""",
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId7" Type="t/hyperlink" Target="http://a.b/?x=1&amp;y=2" TargetMode="External"/></Relationships>',
    "word/styles.xml": f"""<w:styles {W}><w:style w:type="paragraph" w:styleId="ListB"><w:name w:val="List Bullet"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style>
<w:style w:type="paragraph" w:styleId="ListC"><w:name w:val="List C"/><w:basedOn w:val="ListB"/><w:pPr><w:spacing w:before="220" w:after="0"/><w:jc w:val="both"/><w:ind w:left="110" w:firstLine="0"/></w:pPr></w:style>
<w:style w:type="table" w:styleId="Grid"><w:name w:val="Grid"/><w:tcPr><w:tcBorders><w:top w:val="single" w:sz="8" w:color="auto"/></w:tcBorders></w:tcPr><w:tblStylePr w:type="firstRow"><w:tcPr><w:shd w:fill="111111"/></w:tcPr></w:tblStylePr>
<w:tblStylePr w:type="band1Horz"><w:tcPr><w:shd w:fill="222222"/></w:tcPr></w:tblStylePr><w:tblStylePr w:type="band2Horz"><w:tcPr><w:shd w:fill="333333"/></w:tcPr></w:tblStylePr><w:tblStylePr w:type="lastRow"><w:tcPr><w:shd w:fill="444444"/></w:tcPr></w:tblStylePr></w:style></w:styles>""",
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
}


@pytest.fixture(scope="module")
def members(spark):
    return files.members(spark.createDataFrame([("a.docx", archive(PARTS)), ("b.docx", archive(PARTS))], "path string, content binary")).cache()


@pytest.fixture(scope="module")
def blocks(members):
    rows = docx.body_blocks(members).collect()
    assert sorted((r.ord, r.html) for r in rows if r.path == "a.docx") == sorted((r.ord, r.html) for r in rows if r.path == "b.docx")
    return [r for r in sorted(rows, key=lambda r: r.ord) if r.path == "a.docx"]


def test_list_levels(blocks):
    lists = [r.html for r in blocks if r.kind == "list"]
    assert lists[0] == "<ul><li>zero<ol><li>one<ol><li>two</li></ol></li></ol></li><li>again</li></ul>" and lists[1] == "<ol><li>other</li></ol>"


def test_links(blocks):
    assert '<p>see <a href="http://a.b/?x=1&amp;y=2">one </a><a href="http://a.b/?x=1&amp;y=2"><span style="font-weight:bold">two</span></a> and <a href="#top">up</a></p>' in [r.html for r in blocks]


def test_numbering_of_styles(blocks):
    assert [r.html for r in blocks if r.kind == "list"][2] == "<ul><li>by style</li><li>by style too</li></ul>" and "<p>no list</p>" in [r.html for r in blocks]


def test_merged_cells(blocks):
    table = [r.html for r in blocks if r.kind == "table"][0]
    assert table == (
        '<table><tbody><tr><td rowspan="3">a</td><td colspan="2">b</td><td>c</td></tr><tr><td>d</td><td>e</td><td>f</td></tr><tr><td colspan="2">h</td><td>i</td></tr></tbody></table>'
    )


def test_merges_follow_the_grid(spark):
    parts = {"word/document.xml": f"<w:document {W}><w:body><w:tbl>{row(cell('a'), cell('b', START))}{row(cell('c', GO), props='<w:trPr><w:gridBefore w:val=\"1\"/></w:trPr>')}{row(cell('d', WIDE))}{row(cell('e'), cell('f', GO))}</w:tbl></w:body></w:document>"}
    members = files.members(spark.createDataFrame([("a.docx", archive(parts))], "path string, content binary"))
    rows = sorted(docx.body_cells(members, docx.body(members)).collect(), key=lambda r: r.tc)
    # the last cell has nothing to go on with: a cell of two columns lies between
    assert [(r.row, r.col, r.rowspan, r.colspan) for r in rows] == [(0, 0, 1, 1), (0, 1, 2, 1), (2, 0, 1, 2), (3, 0, 1, 1), (3, 1, 1, 1)]


def test_table_styles(blocks):
    table = [r.html for r in blocks if r.kind == "table"][1]
    top = "border-top:2px solid #000000"
    # the bands come after the first row in the style, the last row after the bands
    assert table == (
        f'<table><tbody><tr><td style="{top};background-color:#333333">r0</td></tr><tr><td style="width:100px;{top};background-color:#222222">r1</td></tr>'
        f'<tr><td style="{top};background-color:#333333">r2</td></tr><tr><td style="background-color:#00FF00;{top}">r3</td></tr></tbody></table>'
    )


def test_lists_in_cells(blocks):
    assert [r.html for r in blocks if r.kind == "table"][2] == "<table><tbody><tr><td>in <ul><li>p<ol><li>q</li></ol></li><li>r</li></ul></td></tr></tbody></table>"


def test_drop_downs_and_other_controls(blocks):
    html = [r.html for r in blocks]
    assert '<p>pick: <select><option value="r">Red</option><option value="b" selected="selected">Blue &amp; co</option></select></p>' in html and "<p>in a control</p>" in html


def test_paragraph_properties_of_styles(members):
    got = {r.style: r.css for r in docx.style_properties(members).where("path = 'a.docx'").collect()}
    assert got["ListC"] == "margin-top:20px;margin-bottom:0px;text-align:justify;text-indent:10px" and got["ListB"] == ""


def test_a_body_is_parsed_once(members):
    tree = docx.body(members)
    assert docx.body(tree) is tree
    assert "MapInPandas" not in tree._jdf.queryExecution().optimizedPlan().toString()


def test_cells_with_marks_in_their_text(spark):
    cells = spark.createDataFrame([(1, 1, 1, 1, 1, "<@b></@>")], "t int, row int, col int, rowspan int, colspan int, text string")
    assert emit.tables(cells, ["t"], 1, 0).first().html == "<table><thead><tr><th><@b></@></th></tr></thead></table>"
