"""Make the table and Arrow functions available to SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from disarm.functions.segments import image_segments
from disarm.functions.zips import ArchiveEntries, zip_listing


def register(spark: SparkSession) -> None:
    """``SELECT … FROM files, LATERAL archive_entries(content, NULL)``; ``image_segments(content, type)``; ``zip_listing(content)``."""
    spark.udtf.register("archive_entries", ArchiveEntries)
    spark.udf.register("image_segments", image_segments)
    spark.udf.register("zip_listing", zip_listing)
