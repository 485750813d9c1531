"""Reading files to inspect, and writing what comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disarm import rules

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def _as_files(raw: DataFrame, max_size: int) -> DataFrame:
    """A row per file. Of one over the size cap only the metadata are read: no content, but a reason."""

    def rows(which: DataFrame, content: Column, reason: Column) -> DataFrame:
        return which.select(
            F.col("path").alias("file_id"), F.substring_index("path", "/", -1).alias("filename"), content.alias("content"),
            F.col("length").alias("content_length"), F.col("modificationTime").alias("received_at"), reason.alias("reject_reason"),
        )

    within = rows(raw.where(F.col("length") <= max_size), F.col("content"), F.lit(None).cast("string"))
    return within.unionByName(rows(raw.where(F.col("length") > max_size), F.lit(None).cast("binary"), F.lit("file_too_large")))


def read_files(
    spark: SparkSession, path: str, max_size: int = rules.MAX_FILE_BYTES, glob: str | None = None
) -> DataFrame:
    """Files below a folder. The size cap is checked before any byte is read; a file over it has null content and a ``reject_reason``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _as_files(reader.load(path), max_size)


def stream_files(
    spark: SparkSession, path: str, max_files: int | None = None, max_size: int = rules.MAX_FILE_BYTES
) -> DataFrame:
    """Files as they arrive in a folder, with the same cap and rows as :func:`read_files`."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _as_files(reader.load(path), max_size)


def write_clean(inspected: DataFrame, files: DataFrame, path: str) -> None:
    """Write non-empty outputs as ``sanitized_<name>``, one folder per status."""
    names = files.select("file_id", F.concat(F.lit("sanitized_"), "filename").alias("filename"))
    (
        inspected.where(F.octet_length("output") > 0)
        .select("file_id", "status", F.col("output").alias("content"))
        .join(names, "file_id")
        .write.partitionBy("status")
        .parquet(path)
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Write a ``line`` column (audit log, metrics) as text."""
    lines.select("line").write.text(path)
