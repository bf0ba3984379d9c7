"""Odd inputs of the readers and of markup."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import closure, markup
from folioflow.sources import epub, files, idml, xml
from tests.test_sources import archive


def members(spark, parts):
    return files.members(spark.createDataFrame([("a", archive(parts))], "path string, content binary"))


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<p>a < b and c</p>", [("p", "a < b and c")]), ("<p title='x>y'>z</p>", [("p", "z")]), ("<p title='x>y'></p><i>q</i>w", [("/p", "qw")]), ("before<p>after</p>", [("", "before"), ("p", "after")]),
        ("<p class=it's>x</p>", [("p", "x")]), ('<p title="a<b">x</p>', [("p", "x")]), ("<p>1<2 <b>bold</b> 3 <</p>", [("p", "1<2 bold 3 <")]), ("\n <p>x</p>", [("p", "x")]), ("plain", [("", "plain")]), ("", []), (None, []), ("<p>" + "x < y " * 20_000 + "</p>", [("p", ("x < y " * 20_000).strip())]),
    ],
)
def test_blocks_keep_all_text(spark, html, blocks):
    rows = markup.blocks(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("ord").collect()
    assert [(r.tag or "", r.text) for r in rows] == blocks


def test_nested_changes(spark):
    story = '<Story Self="u"><Change ChangeType="DeletedText"><Change ChangeType="InsertedText"><Content>in</Content></Change><Content>gone</Content></Change><Content>kept</Content><Change ChangeType="InsertedText"><Content> new</Content><Change ChangeType="DeletedText"><Content>x</Content></Change></Change></Story>'
    assert idml.story_text(members(spark, {"Stories/Story_u.xml": story})).first().text == "kept new"


def test_repeated_keys_of_a_listing(spark):
    assert spark.range(1).select(files.pdf_info(F.lit("Title: a\nPages: 3\nTitle: b"))).first()[0] == {"Title": "a", "Pages": "3"}


def test_entries_below_a_dropped_one(spark):
    nav = '<html xmlns:epub="e"><nav epub:type="toc"><ol><li><a href="1">One</a></li><li><a href="2"> </a><ol><li><a href="3">Three</a></li></ol></li><li><span>no link</span><ol><li><a href="4">Four</a></li></ol></li><li><a href="5">Five</a><ol><li><a href="6">Six</a></li></ol></li></ol></nav></html>'
    opf = '<package version="3.0"><manifest><item id="n" href="nav.xhtml" properties="nav"/></manifest></package>'
    parts = {"META-INF/container.xml": '<c><rootfiles><rootfile full-path="b.opf" media-type="application/oebps-package+xml"/></rootfiles></c>', "b.opf": opf, "nav.xhtml": nav}
    assert [(r.label, r.level) for r in epub.nav(members(spark, parts)).orderBy("ord").collect()] == [("One", 0), ("Five", 0), ("Six", 1)]


def test_hidden_subtrees(spark):
    story = '<B><X MarkupTag="XMLTag/Hidden" XMLContent="a"><X XMLContent="b"><X MarkupTag="XMLTag/Hidden" XMLContent="c"/></X></X><X XMLContent="d"/></B>'
    assert {r.id for r in idml.hidden_ids(members(spark, {"XML/BackingStory.xml": story})).collect()} == {"a", "b", "c"}


def test_attributes_of_one_local_name(spark):
    rows = spark.createDataFrame([("p", "m", bytearray(b'<a xmlns:x="u" xmlns:y="v" x:id="1" id="2" y:id="3" x:only="4"/>'))], "path string, member string, content binary")
    assert xml.nodes(rows).first().attrs == {"id": "2", "only": "4"}


def test_descendants_of_documents_without_a_key(spark):
    nodes = spark.createDataFrame([(None, 1, None, 0), (None, 2, 1, 0), (None, 3, 2, 1), (7, 1, None, 0), (7, 2, 1, 0)], "doc int, node int, parent int, hit int")
    got = {(r.doc, r.node): r.has for r in closure.with_descendant(nodes, F.col("hit") == 1, keys=["doc"]).collect()}
    assert got == {(None, 1): True, (None, 2): True, (None, 3): False, (7, 1): False, (7, 2): False}
