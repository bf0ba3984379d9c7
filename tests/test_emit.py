"""Edge cases of markup that is written, rewritten and cleaned."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import word
from folioflow.operators import emit, filters, markup


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_nested_empty_elements_are_pruned(spark):
    deep = "<div>" * 40 + "</div>" * 40
    html = f'a{deep}<td></td><span style="color:red"></span><span style="height:2px"></span><p>b<i></i></p>'
    assert one(spark, markup.pruned(F.col("h")), h=html) == 'a<td></td><span style="height:2px"></span><p>b</p>'
    assert one(spark, markup.pruned(F.col("h")), h="") == ""
    assert spark.range(1).select(markup.pruned(F.lit(None).cast("string")).alias("x")).first().x is None


def test_table_attributes_become_style(spark):
    assert one(spark, markup.table_styles(F.col("h")), h='<td width="5" style=" a:b ">x</td><p width="5">') == '<td style="a:b; max-width: 5">x</td><p width="5">'
    assert one(spark, markup.table_styles(F.col("h")), h="1 < 2 <table>") == "1 < 2 <table>"


def test_math_gets_its_namespace(spark):
    assert one(spark, markup.math_namespace(F.col("h")), h="<math><mi>x</mi></math>") == f'<math xmlns="{markup.MATHML}"><mi>x</mi></math>'


def test_rules_of_unused_classes_go(spark):
    css = "\n.text_style1 {a:b}\n.text_style2 {c:d}"
    assert one(spark, markup.used_rules(F.col("c"), F.col("h")), c=css, h='<div id="1" class="y text_style2">') == "\n.text_style2 {c:d}"


def test_serialized_trees_nest(spark):
    rows = [("t", 0, 0, "a", {}, "x"), ("t", 1, 1, "b", {"k": "v"}, None), ("t", 2, 2, "c", {}, "y"), ("t", 3, 1, "b", {}, ""), ("u", 0, 0, "a", {}, "")]
    nodes = spark.createDataFrame(rows, "doc string, pre int, depth int, tag string, attrs map<string,string>, text string")
    got = {r.doc: r.html for r in emit.serialized(nodes, ["doc"]).collect()}
    assert got == {"t": '<a>x<b k="v"><c>y</c></b><b></b></a>', "u": "<a></a>"}


def test_blocks_without_content_hold_a_space(spark):
    rows = spark.createDataFrame([(1, 1, "br", ""), (1, 2, "t", "a"), (1, 3, "t", "b"), (1, 4, "br", "")], "p int, n int, kind string, text string")
    got = emit.paragraphs(rows, ["p"], ["n"], F.col("kind") == "br", F.col("kind"), F.col("text")).orderBy("block").collect()
    assert [r.html for r in got] == ["<div>&#160;</div>", '<div><span class="t">a</span><span class="t">b</span></div>']


def test_styles_that_are_not_there(spark):
    assert one(spark, word.style(F.col("x")), x="") == ""
    assert one(spark, word.style(F.col("x")), x="<w:style><w:rPr><w:bCs/></w:rPr></w:style>") == "margin-top:0px;margin-bottom:0px"
    assert one(spark, word.borders(F.col("x")), x="<w:tcBorders/>") == ""


def test_another_source_type_ends_the_job(spark):
    rows = spark.createDataFrame([("epub",), (None,)], "kind string")
    with pytest.raises(Exception, match="expected a source of type idml"):
        filters.checked_type(rows, F.col("kind"), "idml").collect()
