import corpus_pipeline
from tapeloom.llm.common import written

from test_operators import SCHEMA, corpus


def test_stages_on_odd_rows(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(path)
    docs = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        docs = out
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_stages_on_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_run_over_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = packed.select("doc_id").distinct().count()
    assert 0.6 * docs.count() < kept < docs.count()
    toxic_or_bad = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0")
    assert packed.join(toxic_or_bad, "doc_id", "left_semi").select("doc_id").distinct().count() <= 0.2 * toxic_or_bad.count()
