"""What only shows in larger tables: numbers past their padding, many small members, maps that are made again and again."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from folioflow import registry
from folioflow.sources import docx, idml, xml
from tests.same import agrees


def test_page_numbers_past_their_padding(spark, tmp_path):
    keys = [1, 4, 999_999, 1_000_001, 1_234_567, 12_345_678]
    pq.write_table(pa.table({"p_partkey": pa.array(keys, pa.int64()), "p_size": pa.array(range(len(keys)), pa.int32())}), f"{tmp_path}/part.parquet")
    agrees(spark, registry.queries()["S16_page_files"], registry.oracle_sql()["S16_page_files"], str(tmp_path))


def test_members_share_batches(spark):
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("path"), F.lit("m").alias("member"), F.encode(F.lit('<a><b x="1">t</b></a>'), "UTF-8").alias("content"))
    def sizes(parts):
        for b in parts:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    batches = [r.n for r in xml.nodes(rows).mapInArrow(sizes, "n long").collect()]
    assert sum(batches) == 6000
    # one for each member before
    assert len(batches) <= 2 * 2 * spark.sparkContext.defaultParallelism


def test_small_members_are_read_by_several_tasks(spark):
    rows = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("path"), F.lit("m").alias("member"), F.encode(F.lit("<a/>"), "UTF-8").alias("content"))
    assert xml.nodes(rows).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_owners_seen_while_parsing_are_those_of_windows(spark):
    content = b'<d><p><r><t/></r><p><r/></p></p><x/><r><r><t/></r></r><sdt><sdtPr><comboBox/></sdtPr><r/></sdt><sdt><sdtPr/></sdt></d>'
    rows = spark.createDataFrame([("a", "m", bytearray(content)), ("b", "m", bytearray(b"<p><p/></p>")), ("c", "m", bytearray(b"<p>"))], "path string, member string, content binary")
    got = xml.nodes(rows, owners={"p": xml.tagged("p"), "r": xml.tagged("r")})
    want = xml.owned(xml.owned(xml.nodes(rows), "p"), "r")
    assert got.select("path", "node_id", "p", "r", "error").exceptAll(want.select("path", "node_id", "p", "r", "error")).isEmpty() and got.count() == want.count()
    tree = docx.body(spark.createDataFrame([("a", "word/document.xml", bytearray(content))], "path string, member string, content binary"))
    assert {r.choice for r in tree.where("choice is not null").collect()} == {tree.where("tag = 'sdt'").agg(F.min("node_id")).first()[0]}


def test_tints_are_folded_once(spark):
    graphic = '<G><Color Self="Color/a" Space="RGB" ColorValue="0 0 0"/>' + "".join(f'<Tint Self="Tint/{i}" BaseColor="{"Color/a" if i == 0 else f"Tint/{i - 1}"}" TintValue="100"/>' for i in range(30)) + '<Gradient Self="Gradient/g" Type="Linear"><GradientStop StopColor="Tint/29" Location="0"/></Gradient></G>'
    held = idml.swatches(spark.createDataFrame([("a", "Resources/Graphic.xml", bytearray(graphic.encode()))], "path string, member string, content binary"))
    rows = held.select("path", F.explode("swatches").alias("self", "swatch")).where("swatch.kind is not null")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
    assert [(r.self, r.swatch.stops[0].rgb) for r in rows.collect()] == [("Gradient/g", "#000000")]
