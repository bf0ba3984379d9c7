"""Trees rebuilt from the paths that their nodes carry.

A marked node names its place: ``parents``, the definitions from the root down to its parent, and a tag with a hash. A
definition is ``tag.class{json}#hash``, all but the tag optional. Definitions with one hash (or, without hashes, of one tag and
class) are one node wherever they occur, and so are marked nodes with that hash. Each such node hangs where the first of them in
document order puts it, and children come in the order in which they were first seen.

All is done for whole documents at once: every step of every path is an event with its place in the document; a node is
the first event of its key. What an event hangs on was seen before it, so the result is a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import closure
from folioflow.storage import written

# The attributes of marked nodes, and the beginnings of names that are markers.
PARENTS, TAG, HASH, CLASS, MORE = "data-pxe-parents", "data-pxe-tag", "data-pxe-hash", "data-pxe-class", "data-pxe-attributes"
MARKERS = ("data-pxe", "data-ca")
ROOT = "body"


def words(text: Column) -> Column:
    """The words of an attribute; none for null or blank ones; P36."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def definition(text: Column) -> Column:
    """tag, class, attributes (JSON, or null), hash and key of a definition; P36."""
    bare, hashed = F.substring_index(text, "#", 1), F.contains(text, F.lit("#"))
    hash_ = F.when(hashed, F.split_part(text, F.lit("#"), F.lit(2)))
    more = F.nullif(F.regexp_extract(bare, r"(\{.*\})", 1), F.lit(""))
    plain = F.regexp_replace(bare, r"\{.*\}", "")
    tag, class_ = F.substring_index(plain, ".", 1), F.when(F.contains(plain, F.lit(".")), F.split_part(plain, F.lit("."), F.lit(2))).otherwise("")
    return F.struct(tag.alias("tag"), class_.alias("class"), more.alias("attributes"), hash_.alias("hash"), F.coalesce(F.concat(F.lit("#"), hash_), F.concat(tag, class_)).alias("key"))


def _json(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def _at(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _entries(m: Column) -> Column:
    return F.map_entries(m)


def rebuilt(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, node, parent, ord, tag, attrs, text of the rebuilt tree of each document; P26, P35, J25, A20.

    ``nodes``: ``keys``, node_id (in preorder), parent_id, depth, last (node below), tag, attrs, pieces (the texts before the first child and after each child). The
    root of a document becomes the root, named ``body``; nodes without a tag of their own are kept as they are, texts are nodes
    without a tag. A new node has its class before that of the node that made it, and its other attributes but markers; of later
    nodes with its hash the attributes' words are added to its own. A definition of ``body`` in a path gives the root its class, the last one's.
    """
    rows = nodes.withColumn("_path", F.transform(words(_at(PARENTS)), definition)).withColumn("_of", F.get(words(_at(TAG)), F.lit(0))).withColumn("_hash", F.get(words(_at(HASH)), F.lit(0)))
    rows = rows.withColumn("_bodies", F.filter("_path", lambda d: F.startswith(F.lower(d.tag), F.lit(ROOT)))).withColumn("_path", F.filter("_path", lambda d: ~F.startswith(F.lower(d.tag), F.lit(ROOT))))
    hashed = F.when(F.col("_hash").isNull(), F.raise_error(F.lit("a marked node has no hash"))).otherwise(F.concat(F.lit("#"), F.col("_hash")))
    me = F.when(F.col("node_id") == 0, ROOT).when(F.col("_of").isNotNull(), hashed).otherwise(F.concat(F.lit("@"), F.col("node_id").cast("string")))
    rows = written(rows.withColumn("_me", me).withColumn("_marked", F.size(words(_at(PARENTS))) > 0).select(*keys, "node_id", "parent_id", "depth", "last", "tag", "attrs", "pieces", "_path", "_bodies", "_of", "_me", "_marked"))
    above = rows.select(*keys, F.col("node_id").alias("parent_id"), F.col("_me").alias("_above"))
    on = rows.join(above, [*keys, "parent_id"], "left")
    none = F.create_map().cast("map<string,string>")
    # the steps of paths: each hangs on the step before it
    steps = on.select(*keys, "node_id", "_path", F.posexplode("_path").alias("i", "d"))
    hangs = F.when(F.col("i") > 0, F.get("_path", F.col("i") - 1).key).otherwise(ROOT)
    made = F.map_concat(F.map_filter(_json(F.col("d.attributes")), lambda k, v: k != "class"), F.when(F.col("d.class") != "", F.create_map(F.lit("class"), F.col("d.class"))).otherwise(none))
    steps = steps.select(*keys, F.struct("node_id", F.lit(0).alias("k"), F.col("i").alias("i")).alias("ord"), F.col("d.key").alias("node"), hangs.alias("parent"), F.col("d.tag").alias("tag"), made.alias("attrs"), F.lit(None).cast("map<string,string>").alias("added"))
    # the nodes themselves
    last = F.when(F.col("_marked"), F.coalesce(F.get("_path", F.size("_path") - 1).key, F.lit(ROOT))).otherwise(F.coalesce("_above", F.lit(ROOT)))
    own = definition(F.concat(F.col("_of"), F.coalesce(F.concat(F.lit("."), F.get(words(_at(CLASS)), F.lit(0))), F.lit(""))))
    both = F.concat_ws(" ", F.nullif(own["class"], F.lit("")), F.nullif(_at("class"), F.lit("")))
    kept = F.map_filter("attrs", lambda k, v: ~(F.startswith(k, F.lit(MARKERS[0])) | F.startswith(k, F.lit(MARKERS[1])) | (k == "class")))
    more = F.map_filter(_json(_at(MORE)), lambda k, v: ~F.map_contains_key(kept, k) & (k != "class"))
    new = F.map_concat(more, kept, F.when(both != "", F.create_map(F.lit("class"), both)).otherwise(none))
    attrs = F.when(F.col("_of").isNull(), F.col("attrs")).otherwise(new)
    # what a node adds to one that is already there: its attributes but for markers, and those that the markers name
    plain = F.map_filter("attrs", lambda k, v: ~F.contains(k, F.lit("pxe")))
    named = F.map_zip_with(F.map_concat(_json(_at(MORE)), F.when(_at(CLASS).isNotNull(), F.create_map(F.lit("class"), _at(CLASS))).otherwise(none)), plain, lambda k, a, b: F.concat_ws(" ", b, a))
    nodes_ = on.where("node_id > 0").select(
        *keys, F.struct("node_id", F.lit(1).alias("k"), F.lit(0).alias("i")).alias("ord"), F.col("_me").alias("node"), last.alias("parent"), F.when(F.col("_of").isNull(), F.col("tag")).otherwise(own["tag"]).alias("tag"), attrs.alias("attrs"),
        F.when(F.col("_of").isNotNull(), named).alias("added"),
    )
    # texts, after the element or the end of the child before them; of two at one place the deeper comes first
    ends = rows.select(*keys, F.col("parent_id").alias("up"), "node_id", "last").groupBy(*keys, "up").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "last"))), lambda s: s.last).alias("ends"))
    pieces = rows.join(ends.withColumnRenamed("up", "node_id"), [*keys, "node_id"], "left").select(*keys, "node_id", "depth", "_me", "ends", F.posexplode("pieces").alias("i", "text")).where("text <> ''").where("node_id > 0")
    after = F.when(F.col("i") == 0, F.col("node_id")).otherwise(F.get("ends", F.col("i") - 1))
    texts = pieces.select(*keys, F.struct(after.alias("node_id"), F.lit(2).alias("k"), (-F.col("depth")).alias("i")).alias("ord"), F.concat(F.lit("$"), F.col("node_id").cast("string"), F.lit("."), F.col("i").cast("string")).alias("node"), F.col("_me").alias("parent"), "text")
    events = written(steps.unionByName(nodes_))
    first = events.groupBy(*keys, "node").agg(F.min_by(F.struct("ord", "parent", "tag", "attrs"), "ord").alias("f"))
    later = events.join(first.select(*keys, "node", F.col("f.ord").alias("made")), [*keys, "node"]).where("ord > made and added is not null")
    later = later.groupBy(*keys, "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.map_entries("added").alias("added")))), lambda e: F.map_from_entries(e.added)).alias("more"))
    merged = F.aggregate("more", F.col("f.attrs"), lambda have, add: F.map_zip_with(have, add, lambda k, a, b: F.concat_ws(" ", F.when(a.isNotNull(), F.array_join(words(a), " ")), F.when(b.isNotNull(), F.array_join(words(b), " ")))))
    tree = first.join(later, [*keys, "node"], "left").select(*keys, "node", "f.parent", "f.ord", "f.tag", F.when(F.col("more").isNull(), F.col("f.attrs")).otherwise(merged).alias("attrs"), F.lit("").alias("text"))
    classes = rows.where("size(_bodies) > 0").groupBy(*keys).agg(F.max_by(F.element_at("_bodies", -1)["class"], "node_id").alias("class"))
    roots = rows.where("node_id = 0").join(classes, keys, "left").select(
        *keys, F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.struct(F.lit(-1).alias("node_id"), F.lit(0).alias("k"), F.lit(0).alias("i")).alias("ord"), F.lit(ROOT).alias("tag"),
        F.when(F.col("class").isNotNull(), F.create_map(F.lit("class"), F.col("class"))).otherwise(none).alias("attrs"), F.lit("").alias("text"),
    )
    texts = texts.select(*keys, "node", "parent", "ord", F.lit(None).cast("string").alias("tag"), none.alias("attrs"), "text")
    return tree.unionByName(texts).unionByName(roots)


def in_preorder(tree: DataFrame, keys: list[str]) -> DataFrame:
    """``tree`` with pre and depth: each node's place in preorder, children by ``ord``; P28."""
    places = closure.folded(tree, F.array(F.col("ord")), lambda near, far: F.concat(far, near), "place", keys)
    numbered = places.select(*keys, "node", (F.size("place") - 1).alias("depth"), F.row_number().over(Window.partitionBy(*keys).orderBy("place")).alias("pre"))
    return tree.join(numbered, [*keys, "node"])
