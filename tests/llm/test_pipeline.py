import pyarrow as pa

import corpus_pipeline
from folioflow.llm import linededup, mixing, pieces, simhash, toxicity
from tests.conftest import DATA


def test_stages_take_effect(spark):
    folder = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, n = docs.columns, docs.count()
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.score(docs, marks).where("score >= 0.5").collect()}
    clean = corpus_pipeline.toxicity_stage(spark, docs, folder).cache()
    assert clean.columns == names and {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == rejected and rejected
    lines = corpus_pipeline.line_stage(spark, clean, folder).cache()
    assert lines.columns == names and lines.count() == clean.count()
    assert {r.doc_id: r.text for r in lines.collect()} == {r.doc_id: r.text for r in linededup.dedup_lines(clean).collect()}
    single = corpus_pipeline.simhash_stage(spark, lines, folder).cache()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in simhash.similar(lines).collect()} and single.count() < n
    mixed = corpus_pipeline.mixing_stage(spark, single, folder).cache()
    assert mixed.columns == names and mixed.count() == sum(r.copies for r in mixing.mix(single).collect())
    last = corpus_pipeline.pieces_stage(spark, mixed, folder).collect()
    enc = pieces.Encoder()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(last) == mixed.count() and all(r.lossless and enc.decode(r.tokens) == (texts[r.doc_id] or "") for r in last)


def test_run_applies_every_stage(spark):
    out = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert out.count() > 0 and out.where("not lossless").count() == 0


def test_stages_take_odd_rows(spark):
    long = "word salad, " * 20_000
    rows = [(1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (3, "one", "en", "a", 3, 1), (3, "one", "en", "a", 3, 1), (None, "no id", "en", "b", 5, 1), (None, None, None, None, None, 1), (7, long, "en", "c", len(long), 1), (8, long, "en", "c", len(long), 1), (9, "é日本🙂 ▁ \x00\ttab", "fr", "b", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root long")
    for given in (docs, docs.where("false")):
        out = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, f"{DATA}/sf0.001").cache()
            assert name == "pieces" or out.columns == docs.columns
        assert out.where("not lossless").count() == 0 and (out.count() > 0) == (given is docs)


def test_batches_of_long_texts_are_small(spark):
    docs = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat('many words ', 400) as text", "'en' as lang", "'s' as source", "4400L as n_chars")
    corpus_pipeline.pieces_stage(spark, docs, DATA)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) > 16 << 20 and max(r.n for r in sizes) < 6 << 20
