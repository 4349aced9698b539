"""A table by key that batches are merged into, bucket by bucket, with published versions.

Rows lie in buckets by a hash of their key. A batch reads and rewrites the buckets that its keys fall into and
no others. Data folders have names of their own; a version is one small file that names the folder of each bucket,
and appears as a whole once all data is written. Readers hold on to a version, so they never see half a batch; a
job that dies before it publishes leaves the table as it was. Of two writers that started from the same version
the second fails when it publishes. All of it are Spark's own reads and writes, so any shared file system will do.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamis.operators.progress import last_wins

LIVE = "bucket int, folder string"


@dataclass(frozen=True)
class KeyedTable:
    """The table under ``path``. ``buckets`` can't change once there is a version; choose it so that one bucket is
    a task's work (at most a few thousand: their list is what the driver holds)."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    buckets: int = 64

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The last published version; 0 before the first."""
        try:
            found = self.spark.read.schema(f"{LIVE}, version int").json(f"{self.path}/versions").agg(F.max("version")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        return found or 0

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return {r.bucket: r.folder for r in self.spark.read.schema(LIVE).json(f"{self.path}/versions/version={version}").collect()}

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the last."""
        return self._rows(self.folders(version))

    def find(self, value) -> DataFrame:
        """The row of a key, if there is one, from its bucket alone."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(value))).first()[0]
        return self._rows({b: f for b, f in self.folders().items() if b == bucket}).filter(F.col(self.key) == F.lit(value))

    def upsert(self, batch: DataFrame, position: str) -> int:
        """Merges rows in: those of ``batch`` replace rows of the same key, of several with one key the last by
        ``position`` counts. Rows without a key are left out. Gives the new version; an empty batch publishes none.
        ``batch`` is computed twice (its buckets, its rows): store it first where that is dear."""
        version = self.version()
        live = self.folders(version)
        new = batch.filter(F.col(self.key).isNotNull())
        touched = {r[0] for r in new.select(self._bucket(F.col(self.key))).distinct().collect()}
        if not touched:
            return version
        folder = uuid.uuid4().hex
        old = self._rows({b: f for b, f in live.items() if b in touched})
        merged = last_wins(old, new, self.key, position).withColumn("bucket", self._bucket(F.col(self.key)))
        merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        self._publish(version + 1, live | dict.fromkeys(touched, folder))
        return version + 1

    def _publish(self, version: int, live: dict[int, str]) -> None:
        rows = self.spark.createDataFrame(sorted(live.items()), LIVE)
        rows.coalesce(1).write.mode("errorifexists").json(f"{self.path}/versions/version={version}")
