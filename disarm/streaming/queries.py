"""Streaming forms built from plain DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from disarm.functions.digests import sha256_hex
from disarm.operators.verdicts import status_label
from disarm.plans.pipeline import inspect_files
from disarm.staging import clear_staged, mark
from disarm.streaming.stateful import state_store


def inspect_stream(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Inspect files as they arrive: each micro-batch goes through the batch plan into a folder of its own in ``path``.

    A batch that is run again replaces its folder. What it staged is deleted once it is written.
    """

    def inspect(batch: DataFrame, number: int) -> None:
        since = mark()
        inspect_files(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        clear_staged(batch.sparkSession, since)

    return (
        files.writeStream.foreachBatch(inspect)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counters(verdicts: DataFrame) -> DataFrame:
    """Files by type and result, kept up to date (complete or update mode)."""
    return verdicts.groupBy(F.col("original_type").alias("type"), status_label(F.col("status")).alias("result")).agg(
        F.count(F.lit(1)).alias("files")
    )


def windowed_counters(verdicts: DataFrame, width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Files by type and result per event-time window; late rows count until the watermark passes."""
    return (
        verdicts.withWatermark("ts", lateness)
        .groupBy(
            F.window("ts", width, slide or width).alias("window"), F.col("original_type").alias("type"),
            status_label(F.col("status")).alias("result"),
        )
        .agg(F.count(F.lit(1)).alias("files"))
    )


def dedupe_stream(files: DataFrame, lateness: str, content: str = "content") -> DataFrame:
    """First file of each distinct content; a digest is remembered for the watermark delay."""
    hashed = files.withColumn("sha256", sha256_hex(F.col(content).cast("binary")))
    return hashed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["sha256"])


def run_append(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that is there, append the result to ``path`` and read it back."""
    with state_store(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that is there, keeping the latest complete result in ``path``, and read it back."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = (
        stream.writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class Upserts:
    """A table of the latest values by key, fed by a stream in update mode: a micro-batch writes changed groups only.

    Batch N is the folder ``batch=N`` and replaces itself when it is run again. Every ``fold_every`` batches all that is there
    up to then is folded into ``base=N``; what that covers is neither read nor written any more, and deleted a fold later.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], fold_every: int = 50) -> None:
        self.spark, self.path, self.schema, self.keys, self.fold_every = spark, path.rstrip("/"), schema, keys, fold_every

    def _folders(self, kind: str) -> list[int]:
        """Numbers of complete folders."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        names = [s.getPath() for s in files.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith(kind + "=") and files.exists(hadoop.Path(p, "_SUCCESS")))

    def _delete(self, kind: str, number: int) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={number}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}={number}").withColumn("_batch", F.lit(number).cast("long"))

    def table(self) -> DataFrame:
        """The latest values of each key."""
        base = max(self._folders("base"), default=None)
        parts = [self._read("base", base)] if base is not None else []
        parts += [self._read("batch", n) for n in self._folders("batch") if base is None or n > base]
        rows = self.spark.createDataFrame([], f"{self.schema}, _batch long") if not parts else reduce(DataFrame.unionByName, parts)
        values = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
        return latest.select(*self.keys, *[F.col(f"_v.{c}").alias(c) for c in values])

    def write(self, batch: DataFrame, number: int) -> None:
        """What ``foreachBatch`` calls."""
        bases = self._folders("base")
        if bases and number <= bases[-1]:
            return  # folded in already
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if (number + 1) % self.fold_every == 0:
            self.table().write.mode("overwrite").parquet(f"{self.path}/base={number}")
            covered = bases[-1] if bases else -1
            for kind in ("batch", "base"):
                for n in self._folders(kind):
                    if n < covered or kind == "batch" and n == covered:
                        self._delete(kind, n)


def run_update(stream: DataFrame, upserts: Upserts, checkpoint: str) -> DataFrame:
    """Process everything that is there in update mode and return the table of latest values."""
    query = (
        stream.writeStream.outputMode("update").foreachBatch(upserts.write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return upserts.table()


def stream_table(
    spark: SparkSession, path: str, name: str = "*.parquet", max_files: int | None = None, max_bytes: int = 1 << 30
) -> DataFrame:
    """The Parquet files of a folder as a stream, oldest first; ``name`` picks files by pattern.

    A micro-batch holds at most ``max_files`` files or, if that is not given, about ``max_bytes`` bytes, so what
    stateful operators order within one is bounded too.
    """
    schema = spark.read.option("pathGlobFilter", name).parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    else:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)
