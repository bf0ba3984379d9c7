"""XML members as flattened trees: one row for each element, in document order.

Parsing is the one step that Spark's functions can't express for trees of any depth, so it
runs in Python, a member at a time. Its rows go out in batches that are bounded by nodes, whether one
member fills several or many members share one.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.storage import spread

SCHEMA = "path string, member string, node_id int, parent_id int, ord int, depth int, last int, tag string, attrs map<string,string>, text string, pieces array<string>, content string, error string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}
#: The most nodes of a batch.
BATCH = 5000


def _local(name: str) -> str:
    return name.rpartition("}")[2]


#: For ``whole``: the texts of all elements.
ALL = ("*",)


def _attrs(e: ET.Element) -> dict[str, str]:
    """Attributes by local name; of those that share one, that without a prefix counts, or else the first."""
    out = {k: v for k, v in e.attrib.items() if k[:1] != "{"}
    for k, v in e.attrib.items():
        out.setdefault(_local(k), v)
    return out


def tagged(name: str) -> Callable[[ET.Element], bool]:
    """For ``owners``: whether an element has a local tag."""
    return lambda e: _local(e.tag) == name


def nodes_of(content: bytes, whole: tuple[str, ...] = (), owners: tuple[Callable[[ET.Element], bool], ...] = ()):
    """(node, parent, place among its siblings, depth, last node below, local tag, local attributes, own text, its pieces, all text, and an owner for each of ``owners``) in document order.

    Pieces are the texts before the first child and after each child. All text, that of the elements below
    included, is read for the tags in ``whole`` alone. An owner is the outermost node for which it holds, at or above the node.
    """
    root = ET.fromstring(content)
    below = {}
    for e in reversed(list(root.iter())):
        below[e] = sum(below[c] + 1 for c in e)
    stack, n = [(root, -1, 0, 0, (None,) * len(owners))], 0
    while stack:
        e, parent, place, depth, own = stack.pop()
        own = tuple(n if at is None and holds(e) else at for at, holds in zip(own, owners))
        pieces, tag = [e.text or "", *(c.tail or "" for c in e)], _local(e.tag)
        yield n, parent, place, depth, n + below[e], tag, _attrs(e), "".join(pieces), pieces, "".join(e.itertext()) if tag in whole or whole == ALL else None, *own
        stack.extend((c, n, k, depth + 1, own) for k, c in reversed(list(enumerate(e))))
        n += 1


def nodes(members: DataFrame, whole: tuple[str, ...] = (), owners: dict[str, Callable[[ET.Element], bool]] = {}) -> DataFrame:  # noqa: B006
    """The nodes of each XML member of ``members(path, member, content)``; one that can't be read has a single row, of nulls and its ``error``.

    Each of ``owners`` is a column more: as ``owned``, but seen while parsing.
    """
    schema = ", ".join([SCHEMA, *(f"{name} int" for name in owners)])
    columns = [(name, _TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        plain = lambda v, kind: [x if x is None else list(x.items()) for x in v] if pa.types.is_map(kind) else v
        return pa.RecordBatch.from_arrays([pa.array(plain(v, kind), kind) for v, (_, kind) in zip(zip(*held), columns)], [name for name, _ in columns])

    def run(batches):
        held = []
        for rows in batches:
            for path, member, content in zip(*rows.columns):
                path, member = path.as_py(), member.as_py()
                try:
                    for node in nodes_of(content.as_py(), whole, tuple(owners.values())):
                        held.append((path, member, *node[:10], None, *node[10:]))
                        if len(held) == BATCH:
                            yield batch(held)
                            held = []
                except ET.ParseError as e:
                    held.append((path, member, *[None] * 10, str(e), *[None] * len(owners)))
        if held:
            yield batch(held)

    return spread(members.where("content is not null").select("path", "member", "content"), "path", "member").mapInArrow(run, schema)


def owned(tree: DataFrame, owner: str | Column, name: str | None = None, keys: tuple[str, ...] = ("path", "member")) -> DataFrame:
    """Adds the outermost node of tag ``owner``, or for which ``owner`` holds, at or above each node, null outside of any."""
    w = Window.partitionBy(*keys).orderBy("node_id")
    name = name or owner
    owner = F.col("tag") == owner if isinstance(owner, str) else owner
    end = F.max(F.when(owner, F.col("last"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tree = tree.withColumn("_end", end)
    opens = owner & (F.col("_end").isNull() | (F.col("node_id") > F.col("_end")))
    tree = tree.withColumn("_own", F.last(F.when(opens, F.struct("node_id", "last")), ignorenulls=True).over(w))
    return tree.withColumn(name, F.when(F.col("node_id") <= F.col("_own.last"), F.col("_own.node_id"))).drop("_end", "_own")
