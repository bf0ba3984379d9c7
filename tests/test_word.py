"""Word bodies against golden cases."""

import pytest

from folioflow.sources import docx, files
from tests.test_sources import W, archive, para

BODY = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>One &amp; two</w:t></w:r></w:p>{para("Bullet list")}{para("debuggin", None, 1)}{para("work", None, 1)}{para("one", "ListParagraph", 3)}
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{para("outer")}<w:tbl><w:tr><w:tc>{para("inner")}</w:tc></w:tr></w:tbl></w:tc></w:tr><w:tr><w:tc>{para("left")}</w:tc><w:tc>{para("right")}</w:tc></w:tr></w:tbl>
<w:p><w:r><w:rPr><w:b/><w:vertAlign w:val="superscript"/></w:rPr><w:t>b</w:t></w:r><w:r><w:br w:type="page"/><w:t>after</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Last</w:t></w:r></w:p></w:body></w:document>"""
PARTS = {
    "word/document.xml": BODY,
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
}


@pytest.fixture(scope="module")
def members(spark):
    broken = {"word/document.xml": "<w:document"}
    return files.members(spark.createDataFrame([("a.docx", archive(PARTS)), ("bad.docx", archive(broken))], "path string, content binary")).cache()


def test_pages_of_a_body(members):
    pages = {r.page_no: r for r in docx.body_pages(members).collect()}
    assert {r.path for r in pages.values()} == {"a.docx"} and sorted(pages) == [1, 2, 3]
    assert pages[1].title == "One &amp; two" and pages[3].title == "Last"
    assert pages[1].html == (
        "<h1>One &amp; two</h1><p>Bullet list</p><ul><li>debuggin</li><li>work</li></ul><ol><li>one</li></ol>"
        '<table><tbody><tr><td colspan="2">outerinner</td></tr><tr><td>left</td><td>right</td></tr></tbody></table>'
    )
    assert pages[2].html == '<p><span style="font-weight:bold;vertical-align:super">b</span>after</p>'


def test_a_broken_member_says_so(members):
    bad = docx.document_nodes(members).where("path = 'bad.docx'").collect()
    assert len(bad) == 1 and bad[0].node_id is None and bad[0].error
