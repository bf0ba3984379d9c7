import pytest
from pyspark.sql import functions as F

from folioflow.functions import colors, css, text
from folioflow.operators import closure, markup, runs, styles


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_style_merge_keeps_the_receiver(spark):
    a = F.create_map(*(F.lit(x) for x in ("color", "black", "border-style", "solid", "font-weight", "bold")))
    b = F.create_map(*(F.lit(x) for x in ("font-family", "Arial", "display", "inline", "background-color", "#FFFFFF", "color", "white", "font-weight", "italic")))
    got = spark.range(1).select(styles.merged(a, b)).first()[0]
    assert len(got) == 6 and got["color"] == "black" and got["font-weight"] == "bold"


def test_entities_in_one_pass(spark):
    got = one(spark, text.numeric_entities(F.col("t")), t="&eacute;t&eacute; &amp;nbsp; &nope; &nbsp;x")
    assert got == "&#233;t&#233; &amp;nbsp; &nope; &#160;x"


def test_escape_keeps_entities(spark):
    assert one(spark, text.escape(F.col("t")), t="a & b &amp; <c> ") == "a &amp; b &amp; &lt;c&gt;<br />"


def test_colors(spark):
    assert one(spark, colors.to_hex(colors.to_rgb(F.lit("CMYK"), F.lit("0 100 100 0")))) == "#ff0000"
    assert one(spark, colors.to_hex(colors.to_rgb(F.lit("LAB"), F.lit("100 0 0")))) in ("#ffffff", "#fffffe", "#fefffe")
    assert one(spark, colors.indexed(F.lit("abc"))) == "#abc"


def test_leading_defaults(spark):
    assert one(spark, css.leading(F.lit(None).cast("double"), F.lit("Auto"), F.lit(None).cast("int"))) == "line-height:120%"


def test_styles_inherit_through_three_levels(spark):
    rows = [("Normal", None, {"line": "240"}), ("TextBody", "Normal", {"after": "140", "line": "288"}), ("List", "TextBody", {}), ("Loop", "Loop", {"a": "1"})]
    got = dict(styles.flattened(spark.createDataFrame(rows, "style string, based_on string, props map<string,string>")).collect())
    assert got["List"] == {"after": "140", "line": "288"} and got["Loop"] == {"a": "1"}


def test_chains_of_any_length_and_cycles(spark):
    chain = spark.createDataFrame([(d, f"s{i}", f"s{i - 1}" if i else None, {"root": d} if not i else {}) for d in "ab" for i in range(100)], "doc string, style string, based_on string, props map<string,string>")
    assert {(r.doc, r.props["root"]) for r in styles.flattened(chain, ["doc"]).collect()} == {("a", "a"), ("b", "b")}
    nodes = chain.select("doc", F.col("style").alias("node"), F.col("based_on").alias("parent"), F.col("style").alias("style"))
    assert {len(r.styles) for r in styles.ancestry(nodes, ["doc"]).collect()} == set(range(1, 101))
    below = closure.with_descendant(nodes, F.col("node") == "s99", keys=["doc"])
    assert {r.node for r in below.where("not has").collect()} == {"s99"}
    ring = spark.createDataFrame([("a", "b", {}), ("b", "c", {}), ("c", "a", {})], "style string, based_on string, props map<string,string>")
    with pytest.raises(ValueError, match="cycle"):
        styles.flattened(ring)
    assert styles.flattened(ring.where("false")).count() == 0


def test_nested_styles_take_parts_in_turn(spark):
    rows = spark.createDataFrame([("Note: one two. Three",), ("none",)], "t string")
    got = rows.select(runs.nested_styles(F.col("t"), [("lead", ":", 1, True), ("words", "AnyWord", 2, True)]).alias("p")).collect()
    assert [(x.style, x.text) for x in got[0].p] == [("lead", "Note:"), ("words", " one two."), (None, " Three")]
    assert [(x.style, x.text) for x in got[1].p] == [("lead", "none")]


def test_block_text_is_whole(spark):
    page = spark.createDataFrame([(1, "<html><style>p{}</style><body><p>a <b>b</b><br>c <a href='#'>d</a></p><script>'<p>x</p>'</script>tail<ul><li>e</ul></body>")], "page_id long, html string")
    assert [(r.tag, r.text) for r in markup.blocks(page).orderBy("ord").collect()] == [("p", "a b c d"), ("/p", "tail"), ("li", "e")]


def test_pictures_stay_alone_when_runs_merge(spark):
    rows = spark.createDataFrame([(1, 1, "b", "x"), (1, 2, "b", "y"), (1, 3, "b", "PIC"), (1, 4, "b", "z")], "d int, n int, style string, text string")
    got = runs.merged(rows, ["d"], ["n"], F.col("style"), F.col("text"), F.col("text") == "PIC").orderBy("run").collect()
    assert [r.text for r in got] == ["xy", "PIC", "z"]


def test_empty_rows(spark):
    rows = spark.createDataFrame([], "d int, n int, style string, text string")
    assert runs.islands(rows, ["d"], ["n"], F.col("style")).count() == 0
    assert runs.merged(rows, ["d"], ["n"], F.col("style"), F.col("text")).count() == 0
