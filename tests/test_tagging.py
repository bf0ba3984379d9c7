"""Paths of marked elements, against a reader with a stack."""

import random

import pytest

from folioflow.operators import tagging

ROWS = [
    ("p", ["section", "li", "blockquote"], [], [], False), ("section", [], ["p", "list", "h1", "section", "blockquote"], [], False), ("list", [], ["li"], [], True), ("li", ["list"], ["p", "list"], [], False),
    ("h1", ["header"], [], [], False), ("header", ["section"], ["h1"], [], True), ("blockquote", [], ["quote"], ["quote"], False), ("quote", [], ["p"], [], False), ("em", [], [], [], False),
]


def stacked(nodes, rules):
    """{node: (tag, hash, parents)} by one element after the other with a stack."""
    children = {}
    for node, parent, mark in nodes:
        children.setdefault(parent, []).append((node, mark))
    out, matter = {}, ["bodymatter"]

    def bottom():
        m = matter[0]
        return [f"body.{m}#b-{m}", f"section.chapter#c-{m}", f"section.{m}#m-{m}"]

    def push(stack, tag, hash_, node, up, count, depth=8):
        above = stack[-1].partition("#")[0] if stack else ""
        rule = rules.rule(tag) or {"parents": None}
        wanted = rule["parents"] or []
        if depth and wanted and not any(above == p or ("." not in p and above.partition(".")[0] == p) for p in wanted):
            insert(stack, wanted[0], node, up, count, depth)
            above = wanted[0]
        if depth and not rules.allows(above, tag):
            between = next((c for c in rules.children(above) if rules.allows(c, tag)), None)
            if between is not None:
                insert(stack, between, node, up, count, depth)
        stack.append(f"{tag}#{hash_}")

    def insert(stack, tag, node, up, count, depth):
        # what it needs itself is pushed before it, and counted before it
        at = len(stack)
        push(stack, tag, "?", node, up, count, depth - 1)
        n = count[0] + 0
        hash_ = f"s{up}.{tag.replace('.', '-')}" if rules.singleton(tag) and up is not None else f"n{node}-{n}"
        stack[-1] = f"{tag}#{hash_}"
        count[0] += 1
        assert len(stack) > at

    def visit(node, mark, stack, up):
        tag = (mark or "").removeprefix("XMLTag/").lower()
        if tag in tagging.MATTERS:
            matter[0] = tagging.MATTERS[tag]
        here, mine = list(stack), up
        if tag not in tagging.MATTERS and tag not in tagging.IGNORED and rules.known(tag):
            hash_ = f"s{up}.{tag.replace('.', '-')}" if rules.singleton(tag) and up is not None else f"n{node}"
            push(here, tag, hash_, node, up, [0])
            out[node] = (tag, hash_, " ".join([*bottom(), *here[:-1]]))
            mine = node
        for n, m in children.get(node, []):
            visit(n, m, here, mine)

    for n, m in children.get(None, []):
        visit(n, m, [], None)
    return out


@pytest.fixture(scope="module")
def grammar(spark):
    return spark.createDataFrame(ROWS, tagging.GRAMMAR)


def test_paths_against_a_stack(spark, grammar):
    r = random.Random(4)
    rules = tagging.Rules([x.asDict() for x in grammar.collect()])
    marks = ["XMLTag/p", "XMLTag/P.lead", "XMLTag/section.a", "XMLTag/list", "XMLTag/li", "XMLTag/h1", "XMLTag/em", "XMLTag/blockquote", "XMLTag/div", "XMLTag/story", "XMLTag/unknown", None, "XMLTag/section.frontmatter", "XMLTag/body.backmatter"]
    docs = {}
    for d in range(25):
        docs[d] = [(0, None, "XMLTag/story")] + [(i, r.randrange(max(0, i - 6), i), r.choice(marks)) for i in range(1, r.randrange(2, 40))]
        # a parent before its children in preorder
        order, kids = [], {}
        for n, p, m in docs[d]:
            kids.setdefault(p, []).append((n, m))

        def walk(n, p, m, kids=kids, order=order):
            at = len(order)
            order.append((at, p, m))
            for c, cm in kids.get(n, []):
                walk(c, at, cm)

        walk(0, None, "XMLTag/story")
        docs[d] = order
    rows = spark.createDataFrame([(d, *x) for d, nodes in docs.items() for x in nodes], "doc int, node int, parent int, mark string")
    got = {}
    for x in tagging.placed(rows, grammar, ["doc"]).collect():
        got.setdefault(x.doc, {})[x.node] = (x.tag + (f".{x['class']}" if x["class"] else ""), x.hash, x.parents)
    for d, nodes in docs.items():
        assert got.get(d, {}) == stacked(nodes, rules), d


def test_containers_and_parts(spark, grammar):
    nodes = [(0, None, "XMLTag/story"), (1, 0, "XMLTag/section.frontmatter"), (2, 0, "XMLTag/p"), (3, 0, "XMLTag/section.bodymatter"), (4, 0, "XMLTag/section.one"), (5, 4, None), (6, 5, "XMLTag/li"), (7, 4, "XMLTag/li")]
    rows = spark.createDataFrame([("d", *n) for n in nodes], "doc string, node int, parent int, mark string")
    got = {r.node: r for r in tagging.placed(rows, grammar, ["doc"]).collect()}
    assert sorted(got) == [2, 4, 6, 7] and got[4].container and not got[6].container
    assert got[2].parents == "body.frontmatter#b-frontmatter section.chapter#c-frontmatter section.frontmatter#m-frontmatter section#n2-0"
    # both items share the list that the grammar wants around them
    assert got[6].parents == got[7].parents == "body.bodymatter#b-bodymatter section.chapter#c-bodymatter section.bodymatter#m-bodymatter section.one#n4 list#s4.list"
    assert tagging.placed(rows.where("false"), grammar, ["doc"]).count() == 0


def test_rules_that_need_each_other_end():
    rules = tagging.Rules([{"tag": a, "parents": [b], "children": [], "required": [], "singleton": False} for a, b in (("a", "b"), ("b", "a"))])
    assert len(rules.pushed("", "a")) == 8
