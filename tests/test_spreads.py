"""Pages, items and masters of spreads in the shape that layout programs write."""

import math

import pytest

from folioflow.operators import layout
from folioflow.sources import files, spreads
from tests.test_sources import archive

NS = 'xmlns:idPkg="urn:x"'


def page(name, x, master="n", overrides="", width=300, height=400):
    return f'<Page Self="{name}" Name="{name}" AppliedMaster="{master}" OverrideList="{overrides}" GeometricBounds="0 0 {height} {width}" ItemTransform="1 0 0 1 {x} -200" MasterPageTransform="1 0 0 1 0 0"><Properties><Descriptor/></Properties></Page>'


def path(left, top, right, bottom):
    points = "".join(f'<PathPointType Anchor="{x} {y}" LeftDirection="0 0"/>' for x, y in ((left, top), (left, bottom), (right, bottom), (right, top)))
    return f"<Properties><PathGeometry><GeometryPathType><PathPointArray>{points}</PathPointArray></GeometryPathType></PathGeometry></Properties>"


def item(name, matrix, tag="Rectangle", inside="", box=(0, 0, 20, 10), extra=""):
    return f'<{tag} Self="{name}" ItemLayer="l1" ItemTransform="{matrix}" {extra}>{path(*box) if box else ""}{inside}</{tag}>'


def spread(name, pages, body, kind="Spread"):
    return f'<idPkg:{kind} {NS}><{kind} Self="{name}" PageCount="{len(pages)}" ItemTransform="1 0 0 1 0 500">{"".join(pages)}{body}</{kind}></idPkg:{kind}>'


COS = math.cos(math.pi / 6)
PARTS = {
    "Spreads/Spread_1.xml": spread("s1", [page("p1", 0, "m1", "a2")], item("one", "1 0 0 1 50 50") + item("off", "1 0 0 1 -50 50") + item("hid", "1 0 0 1 50 50", extra='Visible="false"')),
    "Spreads/Spread_2.xml": spread(
        "s2", [page("p2", -300, "m1"), page("p3", 0, "m1")],
        item("turned", "0 1 -1 0 5 0", "TextFrame")  # its centre (10, 5) goes to (0, 10): on both pages, the first has it
        + item("group", "1 0 0 1 100 0", "Group", box=None, inside=item("in1", "1 0 0 1 -90 0") + item("inner", "0 1 -1 0 10 10", "Group", box=None, inside=item("deep", f"{COS} 0.5 -0.5 {COS} 3 4", "Oval")))
        + item("text", "1 0 0 1 -200 0", "TextFrame", inside='<XMLElement><Rectangle Self="no" ItemTransform="1 0 0 1 0 0"/></XMLElement>'),
    ),
    "Spreads/Spread_3.xml": spread("s3", [page("p4", -300, "m2"), page("p5", 0, "n"), page("p6", 300, "gone")], item("far", "1 0 0 1 590 0") + item("edge", "1 0 0 1 590.1 0") + item("none", "1 0 0 1 0 0", "Group", box=None)),
    "MasterSpreads/MasterSpread_1.xml": spread("m1", [page("ml", -300, "m2", "b1"), page("mr", 0, "m2")], item("a1", "1 0 0 1 -100 0") + item("a2", "1 0 0 1 100 0") + item("a3", "1 0 0 1 100 20"), "MasterSpread"),
    "MasterSpreads/MasterSpread_2.xml": spread("m2", [page("mm", 0)], item("b1", "1 0 0 1 10 10") + item("b2", "1 0 0 1 20 10"), "MasterSpread"),
}


@pytest.fixture(scope="module")
def tree(spark):
    return spreads.spread_nodes(files.members(spark.createDataFrame([("a.idml", archive(PARTS)), ("b.idml", archive(PARTS))], "path string, content binary")))


@pytest.fixture(scope="module")
def found(tree):
    return spreads.items(tree).cache()


def test_pages(tree):
    got = {r.page: r for r in spreads.pages(tree).where("path = 'a.idml'").collect()}
    assert len(got) == 9 and got["p2"].side == "left" and got["p3"].side == "right" and got["p6"].pages == 3 and got["p1"].overrides == ["a2"] and got["p5"].master is None
    assert tuple(got["p2"].box) == (-200, -300, 200, 0) and got["mm"].is_master and not got["p1"].is_master


def test_boxes_and_transforms(found):
    got = {r["item"]: r for r in found.where("path = 'b.idml'").collect()}
    assert "no" not in got and got["in1"].level == 1 and got["deep"].level == 2 and got["none"].box is None
    # the inner group's box is that of the turned shape in it, the outer one's that of its two members
    x1, y1, x2, y2 = 3, 4, 20 * COS - 5 + 3, 10 + 10 * COS + 4
    assert tuple(got["inner"].box) == pytest.approx((y1, x1, y2, x2))
    left, right = sorted((-y1 + 10, -y2 + 10))
    top, bottom = sorted((x1 + 10, x2 + 10))
    assert tuple(got["group"].box) == pytest.approx((min(0, top), -90, max(10, bottom), max(-70, right))) and left > -90
    # composed from the inside to the spread
    m = got["deep"].world
    px, py = 7, 2
    x, y = COS * px - 0.5 * py + 3, 0.5 * px + COS * py + 4
    x, y = -y + 10, x + 10
    assert (m.a * px + m.c * py + m.tx, m.b * px + m.d * py + m.ty) == pytest.approx((x + 100, y))


def test_items_are_placed_by_their_centre(tree, found):
    got = {r["item"]: r.page for r in spreads.page_of_items(found, spreads.pages(tree)).where("path = 'a.idml'").collect()}
    assert got == {
        "one": "p1", "off": None, "turned": "p2", "group": "p3", "in1": "p3", "inner": "p3", "deep": "p3", "text": "p2", "far": "p6", "edge": None, "none": None,
        "a1": "ml", "a2": "mr", "a3": "mr", "b1": "mm", "b2": "mm",
    }


def test_pages_show_their_masters_items(tree, found):
    all_pages = spreads.pages(tree)
    rows = spreads.page_items(all_pages, spreads.page_of_items(found, all_pages)).where("path = 'b.idml'").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.page, -r.level, r.ord)):
        got.setdefault(r.page, []).append(r["item"])
    assert got == {"p1": ["b1", "b2", "a3", "one"], "p2": ["b2", "a1", "turned", "text"], "p3": ["b1", "b2", "a2", "a3", "group"], "p4": ["b1", "b2"], "p6": ["far"]}


def test_no_rows(spark, tree):
    none = tree.where("false")
    assert spreads.items(none).count() == 0 and spreads.page_of_items(spreads.items(none), spreads.pages(none)).count() == 0


def test_pages_of_many_elements_are_those_of_all_comparisons(spark):
    import random

    r = random.Random(1)
    pages = [(s, f"p{s}_{i}", i, *(lambda t, le: (t, le, t + r.uniform(1, 900), le + r.uniform(1, 700)))(r.uniform(-500, 500), r.uniform(-900, 900))) for s in range(6) for i in range(r.randrange(1, 6))]
    elements = [(r.randrange(7), i, r.uniform(-1000, 1500), r.uniform(-700, 1200)) for i in range(500)]
    got = layout.pages_of(spark.createDataFrame(elements, "spread int, element int, x double, y double"), spark.createDataFrame(pages, "spread int, page string, ord int, top double, left double, bottom double, right double"))
    want = {(s, e): p for s, e, x, y in elements for p in [next((p for q, p, _, t, le, b, ri in pages if q == s and le <= x <= ri and t <= y <= b), None)] if p}
    assert {(r.spread, r.element): r.page for r in got.collect()} == want and len(want) > 50
