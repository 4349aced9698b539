import os
import zlib

from pyspark.sql import functions as F

from tamis.llm import common


def test_scratch(spark):
    df = spark.range(5).withColumn("x", F.lit(None).cast("string"))
    table = common.materialise(df, "t")
    assert table.dtypes == df.dtypes and table.count() == 5
    where = common.shared_dir(spark)
    assert where == spark.conf.get("spark.checkpoint.dir") and common.new_path(spark, "a") != common.new_path(spark, "a")
    path = f"{where.removeprefix('file://')}/tamis/{spark.sparkContext.applicationId}"
    assert os.path.isdir(path)
    common.drop_scratch(spark)
    assert not os.path.exists(path)


def test_folds(spark):
    got = spark.range(-3, 50).select("id", common.crc_mod("id", 3).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 3 for r in got)
