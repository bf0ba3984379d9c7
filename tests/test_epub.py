import zipfile

import pytest

from folioflow.sources import epub, files

CONTAINER = '<?xml version="1.0"?><container><rootfiles><rootfile full-path="x.txt" media-type="text/plain"/><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" version="2.0"><metadata><dc:title>A Book</dc:title><dc:title>Other</dc:title>
<dc:language>en</dc:language><dc:identifier id="ISBN">978</dc:identifier></metadata><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/>
<item id="a" href="again.xhtml" media-type="application/xhtml+xml"/><item id="t" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="v" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="none"/></spine></package>"""
NCX = '<ncx><navMap><navPoint id="n1"><navLabel><text>One</text></navLabel><content src="a.xhtml"/><navPoint id="n2"><navLabel><text xml:lang="en">T<i>w</i>o &amp; more</text></navLabel><!-- <navPoint/> --><content src="a.xhtml#2"/></navPoint></navPoint><navPoint id="n3"><navLabel><text>Three</text></navLabel><content src="b.xhtml"/></navPoint></navMap></ncx>'
NAV = '<html xmlns:epub="http://www.idpf.org/2007/ops"><nav epub:type="landmarks"><ol><li><a href="z">Z</a></li></ol></nav><nav epub:type="toc"><ol><li id="l1"><a href="a.xhtml">One</a><ol><!-- <li><a href="c">no</a></li> --><li><a href="a.xhtml#2"><b>Tw</b>o &amp; more</a></li></ol></li><li><a href="b.xhtml"></a></li></ol></nav></html>'


@pytest.fixture(scope="module")
def members(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("epub")
    with zipfile.ZipFile(folder / "a.epub", "w") as z:
        for name, body in (("META-INF/container.xml", CONTAINER), ("OEBPS/content.opf", OPF), ("OEBPS/toc.ncx", NCX), ("OEBPS/nav.xhtml", NAV)):
            z.writestr(name, body)
    (folder / "note.txt").write_text("x")
    rows = files.gathered(spark, str(folder), "epub")
    assert {r.role for r in rows.collect()} == {"source", "asset"}
    return files.members(rows.where("role = 'source'")).cache()


def test_package(members):
    pkg = epub.packages(members)
    assert epub.versions(pkg).first().version == 2
    assert [(r.ord, r.href) for r in epub.spine_files(pkg).orderBy("ord").collect()] == [(1, "a.xhtml"), (2, "b.xhtml"), (3, None)]
    assert epub.manifest(pkg).count() == 5
    assert tuple(epub.metadata(pkg).first())[1:] == ("A Book", None, "en", "978")


def test_tables_of_contents(members):
    assert [(r.level, r.id, r.label, r.href) for r in epub.ncx(members).orderBy("ord").collect()] == [(0, "n1", "One", "a.xhtml"), (1, "n2", "Two & more", "a.xhtml#2"), (0, "n3", "Three", "b.xhtml")]
    assert [(r.level, r.label) for r in epub.nav(members).orderBy("ord").collect()] == [(0, "One"), (1, "Two & more")]


def test_broken_archives(spark):
    bad = spark.createDataFrame([("x", bytearray(b"no zip"))], "path string, content binary")
    assert files.members(bad, permissive=True).first().member is None
    with pytest.raises(Exception, match="not a zip file"):
        files.members(bad).collect()


def test_sources_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown source type"):
        files.gathered(spark, str(tmp_path), "nothing")
