"""Admission: what is turned away before inspection, which tags stay, which become metric labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disarm import rules


def profiles(spark: SparkSession, max_size: int = rules.MAX_FILE_BYTES) -> DataFrame:
    """The offered profiles; there is one."""
    return spark.createDataFrame(
        [(rules.DEFAULT_PROFILE, rules.PROFILE_DESCRIPTION, list(rules.CAPABILITIES), max_size)],
        "name STRING, description STRING, capabilities ARRAY<STRING>, max_file_size_bytes BIGINT",
    )


def capability_matrix(offered: DataFrame) -> DataFrame:
    """One row per profile and capability."""
    return offered.select(F.col("name").alias("profile"), F.explode("capabilities").alias("capability"))


def admission(
    requests: DataFrame, known: tuple[str, ...] = (rules.DEFAULT_PROFILE,), max_size: int = rules.MAX_FILE_BYTES
) -> DataFrame:
    """Add ``profile`` (default when empty), ``admitted``, ``reject_status`` and ``reject_reason``.

    ``content_length`` is the declared length; ``actual_length``, where present, is checked too.
    """
    profile = F.when(F.coalesce("profile", F.lit("")) == "", rules.DEFAULT_PROFILE).otherwise(F.col("profile"))
    rows = requests.withColumn("profile", profile)
    unknown = ~F.col("profile").isin(*known)
    reason = F.when(F.col("content_length") > max_size, "file_too_large").when(
        unknown, F.concat(F.lit("unknown_profile: "), "profile")
    )
    if "actual_length" in requests.columns:
        reason = reason.when(F.col("actual_length") > max_size, "file_too_large")
    return (
        rows.withColumn("reject_reason", reason)
        .withColumn("admitted", F.col("reject_reason").isNull())
        .withColumn("reject_status", F.when(F.startswith("reject_reason", F.lit("unknown_profile")), "ERROR"))
    )


def cap_tags(tags: Column) -> Column:
    """Drop empty or long keys and long values, then keep the lowest keys up to the cap."""
    fitting = F.map_filter(
        tags,
        lambda k, v: (F.octet_length(k) > 0)
        & (F.octet_length(k) <= rules.MAX_TAG_KEY)
        & (F.octet_length(v) <= rules.MAX_TAG_VALUE),
    )
    return F.map_from_entries(F.slice(F.array_sort(F.map_entries(fitting)), 1, rules.MAX_TAGS))


def metric_labels(tags: Column) -> Column:
    """The tags that may become group keys."""
    return F.map_filter(tags, lambda k, v: F.lower(k).isin(*rules.METRIC_TAGS))


def policy_action(status: Column, fail_open: Column | bool) -> Column:
    """What a proxy does with a verdict. A missing status (timeout, no connection) fails open or closed."""
    open_ = fail_open if isinstance(fail_open, Column) else F.lit(fail_open)
    return (
        F.when(status.isin("CLEAN", "UNSUPPORTED"), "pass")
        .when(status == "SANITIZED", "replace")
        .when(status == "BLOCKED", "block_403")
        .when(open_, "pass_alert")
        .otherwise("block_alert")
    )
