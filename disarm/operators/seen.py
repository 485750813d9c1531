"""A table of digests seen so far, bucketed by digest, for dedupe against far more content than a batch has."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from disarm.staging import new_folder

#: Buckets of a new table; at least the shuffle width, or Spark may prefer to move the table.
BUCKETS = 64


class SeenDigests:
    """Digests by bucket. Rows that are looked up or added are dealt to the buckets; the table itself never moves.

    ``path`` names the table's folder, a staged one if not given; ``name`` its name in the session's catalog. An existing table
    of that name is taken as it is.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.name = spark, name or f"seen_{uuid.uuid4().hex}"
        self.buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not spark.catalog.tableExists(self.name):
            self._write(spark.createDataFrame([], "sha256 string"), "errorifexists", path or new_folder(spark, "seen"))

    def _write(self, digests: DataFrame, mode: str, path: str | None = None) -> None:
        writer = digests.select("sha256").write.mode(mode).format("parquet").bucketBy(self.buckets, "sha256").sortBy("sha256")
        (writer.option("path", path) if path else writer).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """Rows of ``digests(sha256, …)`` that the table doesn't have; null digests are never seen."""
        return digests.join(self.table().hint("merge"), "sha256", "left_anti")

    def add(self, digests: DataFrame) -> None:
        """Add what isn't there yet. Each bucket gets one file a call, as its rows come from one task."""
        new = self.unseen(digests.select("sha256").where("sha256 IS NOT NULL").distinct())
        self._write(new.repartition(self.buckets, "sha256"), "append")
