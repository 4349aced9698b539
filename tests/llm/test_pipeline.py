from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import common


def test_stages_on_odd_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, "12 34", "en", "s", 5), (9003, "12 34", "en", "s", 5), (9004, "word " * 3000, "en", None, 15000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("size", F.lit("kept")).withColumn("g", F.lit(1)).withColumn("words", F.lit(0)).withColumn("a.b", F.lit(1)).withColumn("_gone", F.lit(1)).withColumn("_row", F.lit(1))
    n = docs.count()
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialise(stage(spark, docs, sf), name)
        assert name == "packing" or out.columns == seen.columns
        rows = out.count()
        if name == "language_id":
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert not ids & {9001, 9002, 9003} and rows >= 0.95 * (n - 4)
        if name == "near_dedup":
            assert out.select("doc_id").distinct().count() == rows and out.select("text").distinct().count() == rows
        docs = out
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_no_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
