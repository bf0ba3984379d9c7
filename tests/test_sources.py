import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.operators import markup, styles
from folioflow.sources import docx, files, idml, sinks
from folioflow.streaming import pages as stream
from tests.conftest import DATA

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def para(text, style=None, num=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{num}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text[:3]}</w:t></w:r><w:r><w:t>{text[3:]}</w:t></w:r></w:p>"


DOCX = {
    "word/document.xml": f"<w:document {W}><w:body>{para('Bullet list')}{para('debuggin', None, 1)}{para('work', None, 1)}{para('one', 'ListParagraph', 3)}</w:body></w:document>",
    "word/styles.xml": f'<w:styles {W}><w:style w:type="paragraph" w:styleId="Normal"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="List"><w:name w:val="List"/><w:basedOn w:val="Normal"/></w:style></w:styles>',
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
}
IDML = {
    "designmap.xml": '<Document xmlns:idPkg="x"><idPkg:Story src="Stories/Story_u1.xml"/><Layer Self="l1" Visible="true"/><Layer Self="l2" Visible="false"/><Hyperlink Source="s1" Destination="d1"/></Document>',
    "Resources/Graphic.xml": '<G><Color Self="Color/Red" Space="CMYK" ColorValue="0 100 100 0"/><Color Self="Color/B" Space="RGB" ColorValue="0 0 255"/><Tint Self="Tint/R" BaseColor="Color/Red" TintValue="50"/><Tint Self="Tint/N" BaseColor="none" TintValue="-1"/></G>',
    "Resources/Fonts.xml": '<F><FontFamily Name="Minion"><Font PostScriptName="Minion-Bold" FontStyleName="Bold"/></FontFamily></F>',
    "Resources/Styles.xml": '<S><ParagraphStyleGroup><ParagraphStyle Self="ParagraphStyle/a" Name="a" PointSize="12"/><ParagraphStyleGroup><ParagraphStyle Self="ParagraphStyle/b" Name="b" Justification="LeftAlign"><Properties><BasedOn type="object">ParagraphStyle/a</BasedOn></Properties></ParagraphStyle></ParagraphStyleGroup></ParagraphStyleGroup></S>',
    "XML/Tags.xml": '<T><XMLTag Self="XMLTag/p" Name="p"/></T>',
    "XML/BackingStory.xml": '<B><XmlElement MarkupTag="XMLTag/ClientHidden" XMLContent="u5"><XmlElement MarkupTag="XMLTag/p" XMLContent="u6"/></XmlElement><XmlElement MarkupTag="XMLTag/p" XMLContent="u7"/></B>',
    "Stories/Story_u1.xml": '<idPkg:Story xmlns:idPkg="x"><Story Self="u1"><Content>one </Content><Change ChangeType="DeletedText"><Content>gone</Content></Change><Content>two</Content></Story></idPkg:Story>',
    "Spreads/Spread_1.xml": '<idPkg:Spread xmlns:idPkg="x"><Spread PageCount="2"/></idPkg:Spread>',
    "Spreads/Spread_2.xml": '<idPkg:Spread xmlns:idPkg="x"><Spread PageCount="1"/></idPkg:Spread>',
}


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return bytearray(out.getvalue())


@pytest.fixture(scope="module")
def word(spark):
    return files.members(spark.createDataFrame([("a.docx", archive(DOCX)), ("b.docx", archive(DOCX))], "path string, content binary")).cache()


@pytest.fixture(scope="module")
def layout(spark):
    return files.members(spark.createDataFrame([("a.idml", archive(IDML))], "path string, content binary")).cache()


def test_word(word):
    got = docx.paragraphs(word).where("path = 'a.docx'").orderBy("p").collect()
    assert [(r.text, r.style, r.num_id) for r in got] == [("Bullet list", None, None), ("debuggin", None, 1), ("work", None, 1), ("one", "ListParagraph", 3)]
    assert sorted((r.num_id, r["items"]) for r in docx.lists(word).where("path = 'b.docx'").collect()) == [(1, 2), (3, 1)]
    assert {(r.style, r.based_on) for r in docx.style_table(word).collect()} == {("Normal", None), ("List", "Normal")}
    assert {(r.num_id, r.level, r.format) for r in docx.numbering(word).collect()} == {(1, 0, "bullet"), (1, 1, "decimal")}


def test_layout(layout):
    assert [tuple(r)[2:] for r in idml.design_map(layout).collect()] == [("Story", "Stories/Story_u1.xml")]
    assert {(r.layer, r.z, r.visible) for r in idml.layers(layout).collect()} == {("l1", 0, True), ("l2", 1, False)}
    assert {r.self: r.hex for r in idml.palette(layout).collect()} == {"Color/Red": "#ff0000", "Color/B": "#0000ff", "Tint/R": "#ff8080", "Tint/N": "#000000"}
    assert tuple(idml.fonts(layout).first())[1:] == ("Minion", "Minion-Bold", "Bold")
    assert tuple(idml.tag_names(layout).first())[1:] == ("XMLTag/p", "p") and tuple(idml.hyperlinks(layout).first())[1:] == ("s1", "d1")
    assert {r.id for r in idml.hidden_ids(layout).collect()} == {"u5", "u6"}
    assert tuple(idml.story_text(layout).first())[1:] == ("u1", "one two") and idml.page_count(layout).first().pages == 3
    flat = {r.style: r.props for r in styles.flattened(idml.declared_styles(layout), ["path"]).collect()}
    assert flat["ParagraphStyle/b"].items() >= {"PointSize": "12", "Justification": "LeftAlign"}.items()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "", "<p>a</p>"), (1, 2, "T", "b"), (2, 1, None, None)], "doc_id int, page_no int, title string, html string")
    sinks.write_pages(rows, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 3 and back.where("doc_id = 1 and page_no = 1").first().title == "Untitled"
    rules = spark.createDataFrame([(1, 2, "b{}"), (1, 1, "a{}"), (1, 3, "a{}")], "doc_id int, ord int, rule string")
    assert sinks.style_sheet(rules, ["doc_id"]).first().css == "a{}\nb{}"
    assets = spark.createDataFrame([(1, 1, "x", False), (1, 2, "y", True), (2, 1, "z", False)], "doc_id int, ord int, path string, is_cover boolean")
    assert {r.doc_id: r.cover for r in sinks.cover(assets).collect()} == {1: "y", 2: ""}
    info = spark.range(1).select(files.pdf_info(F.lit("Title: a: b\nPage size: 612 x 792 pts\nnone"))).first()[0]
    assert info == {"Title": "a: b", "Page size": "612 x 792 pts"}
    assert files.empty_book(spark).first().title == "Page 1"


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    pages.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        stream.write_blocks(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, markup.blocks(pages).select("page_id", "ord", "tag", "text").collect()))
