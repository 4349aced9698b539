"""Shared helpers of the training-data operators: word patterns, tables, shared scratch space."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the query contracts: a word, and what separates words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table ``table`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(docs: DataFrame) -> Column:
    """All columns of a table as one struct, whatever their names (dots and blanks are quoted)."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where a local session has none (tests), a temporary folder is made, set for the session and
    removed at exit. On a cluster the setting is required.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tamis-")
        atexit.register(shutil.rmtree, where.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def drop_scratch(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder; for after its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tamis/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    MADE.append(f"{shared_dir(spark)}/tamis/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}")
    return MADE[-1]


#: Paths of this process that were given out and not dropped.
MADE: list[str] = []


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        MADE.remove(name)


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Partitions of an explicit exchange: what the session has for shuffles."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(column: str, by: int):
    """crc32 of a column's text form, modulo ``by``: the fixed folds of the query contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by
