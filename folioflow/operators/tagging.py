"""Places of marked elements in a grammar: the path of definitions that each one hangs on.

A grammar is a table with a row for each tag: ``tag``, ``parents`` (one of which must be right above it, or none),
``children`` (which may lie in it), ``required`` (children that it must have) and ``singleton`` (one for all in one parent). ``div`` and ``span`` may
lie and hold anything. A reader with a stack would put an element under the innermost open tag and push what the grammar
lacks between them. What it pushes depends on these two tags alone, so it is looked up in a table of pairs of tags
(:func:`repairs`), as large as the grammar allows whatever the number of documents; and a stack is the chain of an element's
ancestors, each with what it pushed, which a fold over the parents puts together for all elements at once. Marks that name a part of the book
(front, body or back matter) change the bottom of the stack for all that comes after them in the document: the last one before an element counts.

The paths are those that :mod:`folioflow.operators.reparent` rebuilds trees from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import escape
from folioflow.operators import closure, reparent
from folioflow.storage import written

# Tags that are passed over, and the parts of a book by the tags that begin them.
IGNORED = ("story", "table", "thead", "th", "tbody", "tr", "td", "tfoot", "cell", "row", "section.chapter")
MATTERS = {f"{t}.{m}": m for t in ("section", "body") for m in ("frontmatter", "bodymatter", "backmatter")}
ANYWHERE = ("div", "span")
GRAMMAR = "tag string, parents array<string>, children array<string>, required array<string>, singleton boolean"


class Rules:
    """A grammar's rows by tag; a tag with a class has the rule of the tag where it has none of its own."""

    def __init__(self, rows):
        self.rows = {r["tag"]: r for r in rows}

    def rule(self, tag: str):
        return self.rows.get(tag) or self.rows.get(tag.partition(".")[0])

    def known(self, tag: str) -> bool:
        return tag in ANYWHERE or self.rule(tag) is not None

    def children(self, tag: str) -> list[str]:
        rule = self.rule(tag)
        return [*(rule["required"] or ()), *(rule["children"] or ())] if rule else []

    def allows(self, above: str, tag: str) -> bool:
        return above in ("", *ANYWHERE) or tag in self.children(above)

    def pushed(self, above: str, tag: str, depth: int = 8) -> list[str]:
        """The tags that go between ``above`` and ``tag``, outermost first; at most ``depth`` deep, so that rules that need each other end."""
        out = []
        if depth and self.known(tag):
            wanted = (self.rule(tag) or {"parents": None})["parents"] or []
            if wanted and not any(above == p or ("." not in p and above.partition(".")[0] == p) for p in wanted):
                out += [*self.pushed(above, wanted[0], depth - 1), wanted[0]]
                above = wanted[0]
            if not self.allows(above, tag):
                between = next((c for c in self.children(above) if self.allows(c, tag)), None)
                if between is not None:
                    out += [*self.pushed(above, between, depth - 1), between]
        return out

    def singleton(self, tag: str) -> bool:
        rule = self.rule(tag)
        return bool(rule and rule["singleton"])


def repairs(pairs: DataFrame, rules: Rules) -> DataFrame:
    """above, tag, pushed (structs of tag and singleton) and singleton (whether ``tag`` is one) for each of ``pairs(above, tag)``."""

    def run(batches):
        for rows in batches:
            found = [rules.pushed(a, t) for a, t in zip(rows["above"], rows["tag"])]
            rows = rows[["above", "tag"]].assign(pushed=[[{"tag": t, "singleton": rules.singleton(t)} for t in f] for f in found], singleton=[rules.singleton(t) for t in rows["tag"]])
            yield rows

    return pairs.mapInPandas(run, "above string, tag string, pushed array<struct<tag: string, singleton: boolean>>, singleton boolean")


def placed(nodes: DataFrame, grammar: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, node, tag, class, hash, parents (definitions, joined by spaces) and container of each element of a known tag; P23, P24, P36.

    ``nodes``: ``keys``, node (in preorder), parent and mark (``XMLTag/tag.class``, or null). Elements of no or an unknown tag, and those
    that are passed over, are transparent. ``container``: whether it holds other elements of known tags, and so is a step of paths rather than an element of the
    result. Hashes are made of a node's number; all singletons of one tag in one parent, pushed ones too, share one. The grammar is a book's schema: it is read by the driver.
    """
    rules = Rules([r.asDict() for r in grammar.collect()])
    tags = sorted({*rules.rows, *ANYWHERE})
    mark = F.lower(F.regexp_replace(F.coalesce("mark", F.lit("")), "^XMLTag/", ""))
    rows = nodes.select(*keys, "node", "parent", mark.alias("tag"))
    known = F.col("tag").isin(*tags) | F.substring_index("tag", ".", 1).isin(*tags)
    passed = F.col("tag").isin(*IGNORED, *MATTERS) | ~known
    matter = F.last(F.coalesce(*(F.when(F.col("tag") == t, m) for t, m in MATTERS.items())), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("node"))
    rows = written(rows.withColumn("matter", F.coalesce(matter, F.lit("bodymatter"))).withColumn("counts", ~passed))
    near = closure.above(rows, F.when(F.col("counts"), F.struct("node", "tag")), F.coalesce, "up", keys)
    rows = rows.join(near, [*keys, "node"]).withColumn("above", F.coalesce("up.tag", F.concat(F.lit("section."), "matter")))
    # only tags that the grammar knows are asked about
    table = F.broadcast(repairs(rows.where("counts").select(F.when(F.col("up").isNull(), "").otherwise(F.col("above")).alias("above"), "tag").distinct(), rules))
    rows = rows.withColumn("above", F.when(F.col("up").isNull(), "").otherwise(F.col("up.tag"))).join(table, ["above", "tag"], "left")
    shared = lambda tag: F.concat(F.lit("s"), F.coalesce(F.col("up.node").cast("string"), F.lit("")), F.lit("."), F.regexp_replace(tag, r"\.", "-"))
    one = F.when(F.col("singleton") & F.col("up").isNotNull(), shared(F.col("tag"))).otherwise(F.concat(F.lit("n"), F.col("node").cast("string")))
    step = lambda tag, hash_: F.concat(tag, F.lit("#"), hash_)
    between = F.transform("pushed", lambda p, i: step(p.tag, F.when(p.singleton & F.col("up").isNotNull(), shared(p.tag)).otherwise(F.concat(F.lit("n"), F.col("node").cast("string"), F.lit("-"), i.cast("string")))))
    none = F.array().cast("array<string>")
    rows = written(rows.select(*keys, "node", "parent", "tag", "matter", "counts", one.alias("hash"), F.coalesce(F.when(F.col("counts"), between), none).alias("between")))
    whole = F.when(F.col("counts"), F.concat("between", F.array(step(F.col("tag"), F.col("hash"))))).otherwise(none)
    chains = closure.folded(rows, whole, lambda near, far: F.concat(far, near), "chain", keys)
    holds = closure.with_descendant(rows, F.col("counts"), "container", keys)
    out = rows.join(chains, [*keys, "node"]).join(holds, [*keys, "node"]).where("counts")
    bottom = [F.concat(F.lit("body."), "matter", F.lit("#b-"), "matter"), F.concat(F.lit("section.chapter#c-"), "matter"), F.concat(F.lit("section."), "matter", F.lit("#m-"), "matter")]
    parents = F.concat_ws(" ", *bottom, F.slice("chain", 1, F.size("chain") - 1))
    return out.select(*keys, "node", F.substring_index("tag", ".", 1).alias("tag"), F.nullif(F.substr("tag", F.length(F.substring_index("tag", ".", 1)) + 2), F.lit("")).alias("class"), "hash", parents.alias("parents"), "container")


def marked(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys`` and html: a page of marked elements in order, which :func:`folioflow.operators.reparent.rebuilt` takes; P25.

    ``rows``: ``keys``, node, tag, class, hash, parents and container as from ``placed``, ``order`` and text. Containers are steps of paths and
    no elements. An element is a division, whose id is its hash; what is in it is text.
    """
    attr = lambda name, value: F.coalesce(F.concat(F.lit(f' {name}="'), F.replace(escape(value), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit(""))
    head = F.concat(F.lit("<div"), attr("id", F.concat(F.lit("pxe-"), "hash")), attr(reparent.PARENTS, F.col("parents")), attr(reparent.TAG, F.col("tag")), attr(reparent.CLASS, F.col("class")), attr(reparent.HASH, F.col("hash")), F.lit(">"))
    div = F.concat(head, escape(F.coalesce("text", F.lit(""))), F.lit("</div>"))
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), div.alias("t"))))
    return rows.where("not container").groupBy(*keys).agg(F.concat(F.lit("<x>"), F.array_join(F.transform(held, lambda e: e.t), ""), F.lit("</x>")).alias("html"))
