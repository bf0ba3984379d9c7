"""Folders of sources to published books."""

import zipfile

import pytest

from folioflow import books
from tests.test_epub import CONTAINER, NCX, OPF
from tests.test_layout_styles import PARTS as STYLED
from tests.test_spreads import item, page, spread
from tests.test_word import PARTS as WORD

NS = 'xmlns:idPkg="urn:x"'
STORY = f"""<idPkg:Story {NS}><Story Self="u1"><ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/Body"><CharacterStyleRange AppliedCharacterStyle="CharacterStyle/$ID/[No character style]"><Content>One &amp; </Content></CharacterStyleRange>
<CharacterStyleRange AppliedCharacterStyle="CharacterStyle/Strong"><Content>two</Content><Content> three</Content><Br/></CharacterStyleRange></ParagraphStyleRange><ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/Body%3aList"><CharacterStyleRange><Br/><Change ChangeType="DeletedText"><Content>gone</Content></Change><Content>last</Content></CharacterStyleRange></ParagraphStyleRange></Story></idPkg:Story>"""
LAYOUT = STYLED | {
    "Stories/Story_u1.xml": STORY,
    "XML/BackingStory.xml": '<B><X MarkupTag="XMLTag/Hidden" XMLContent="secret"/></B>',
    "Spreads/Spread_a.xml": spread("s1", [page("p1", -300, "m1"), page("p2", 0, "m1")], item("f1", "1 0 0 1 -200 0", "TextFrame", extra='ParentStory="u1"') + item("f2", "1 0 0 1 100 -100", "TextFrame") + item("secret", "1 0 0 1 10 0") + item("off", "1 0 0 1 900 0")),
    "MasterSpreads/MasterSpread_m.xml": spread("m1", [page("ml", -300), page("mr", 0)], item("x1", "1 0 0 1 20 -150"), "MasterSpread"),
}


def packed(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


def published(spark, folder, out, kind=None):
    books.publish(books.converted(spark, str(folder), kind), str(out))
    read = lambda t: spark.read.parquet(f"{out}/{t}")
    return {(r.doc_id.rsplit("/", 1)[-1], r.page_no): r for r in read("pages").collect()}, {r.doc_id.rsplit("/", 1)[-1]: r.css for r in read("sheets").collect()}, {(r.doc_id.rsplit("/", 1)[-1], r.path): bytes(r.content) for r in read("assets").collect()}, {r.doc_id.rsplit("/", 1)[-1]: r.cover for r in read("covers").collect()}


def test_word_book(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        packed(tmp_path / f"in/{name}.docx", WORD)
    pages, sheets, assets, covers = published(spark, tmp_path / "in", tmp_path / "out")
    assert sorted(pages) == [(f"{n}.docx", i) for n in "ab" for i in (1, 2, 3)] and pages["a.docx", 3].title == "Last" and "<body><h1>One &amp; two</h1>" in pages["b.docx", 1].html
    assert assets == covers == {}


def test_epub_book(spark, tmp_path):
    (tmp_path / "in").mkdir()
    page_ = lambda t: f'<?xml version="1.0"?><html><head/><body><p>{t}</p><table width="3"></table></body></html>'
    packed(tmp_path / "in/a.epub", {"META-INF/container.xml": CONTAINER, "OEBPS/content.opf": OPF, "OEBPS/toc.ncx": NCX, "OEBPS/a.xhtml": page_("A"), "OEBPS/b.xhtml": page_("B"), "OEBPS/s.css": "p {}", "OEBPS/img/cover.png": b"png", "OEBPS/f.otf": b"font"})
    pages, sheets, assets, covers = published(spark, tmp_path / "in", tmp_path / "out")
    assert [(k, pages[k].title) for k in sorted(pages)] == [(("a.epub", 1), "One"), (("a.epub", 2), "Three")]
    assert '<body><p>A</p><table style="max-width: 3"></table></body>' in pages["a.epub", 1].html
    assert sheets == {"a.epub": "p {}"} and assets == {("a.epub", "images/cover.png"): b"png", ("a.epub", "fonts/f.otf"): b"font"} and covers == {"a.epub": "images/cover.png"}


def test_layout_book(spark, tmp_path):
    (tmp_path / "in").mkdir()
    packed(tmp_path / "in/a.idml", LAYOUT)
    pages, sheets, _, _ = published(spark, tmp_path / "in", tmp_path / "out")
    assert sorted(pages) == [("a.idml", 1), ("a.idml", 2)]
    story = '<p class="BodyPara">One &amp; <span class="StrongChar">two three</span></p><p class="BodyListPara">&#160;</p><p class="BodyListPara">last</p>'
    assert f'<body><div id="f1" style="position:absolute;left:100px;top:200px;width:20px;height:10px">{story}</div></body>' in pages["a.idml", 1].html
    # the master's item comes first; what is hidden or on the pasteboard doesn't
    body = pages["a.idml", 2].html.split("<body>")[1]
    assert body == '<div id="x1" style="position:absolute;left:20px;top:50px;width:20px;height:10px"></div><div id="f2" style="position:absolute;left:100px;top:100px;width:20px;height:10px"></div></body></html>'
    assert ".BodyPara {" in sheets["a.idml"] and ".StrongChar {" in sheets["a.idml"]


def test_image_book_and_formats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("2.png", "1.PNG"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    pages, _, assets, _ = published(spark, tmp_path / "in", tmp_path / "out")
    assert [pages["in", i].title for i in (1, 2)] == ["1.PNG", "2.png"] and assets["in", "images/2.png"] == b"2.png"
    packed(tmp_path / "in/x.docx", WORD)
    assert books.format_of(spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path")) == "word"
    packed(tmp_path / "in/y.epub", {"a": "b"})
    with pytest.raises(ValueError, match="one source format"):
        books.converted(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError, match="unknown source type"):
        books.converted(spark, str(tmp_path / "in"), "other")
