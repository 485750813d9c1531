"""From per-format outcomes to verdicts: modes, digests, counts, audit lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm import rules
from disarm.functions.digests import sha256_hex
from disarm.operators.findings import max_severity


def status_label(status: Column) -> Column:
    """Lower-case label of a status, ``unknown`` outside the closed set."""
    return F.when(status.isin(*rules.STATUSES), F.lower(status)).otherwise("unknown")


def wire_status(status: Column) -> Column:
    """Status name as sent; anything outside the closed set is an error."""
    return F.when(status.isin(*rules.STATUSES), status).otherwise("ERROR")


def mode_output(verdicts: DataFrame, on_blocked: str = "null") -> DataFrame:
    """Apply the mode: report modes return the original bytes whatever the verdict.

    Input has ``content``, ``output`` and ``mode``. Sizes and digest follow the returned bytes.
    ``on_blocked="original"`` also returns the original where enforcing left no clean bytes.
    """
    enforced = F.coalesce("output", "content") if on_blocked == "original" else F.col("output")
    returned = F.when(F.col("mode").isin(*rules.REPORT_MODES), F.col("content")).otherwise(enforced)
    return verdicts.withColumn("output", returned).withColumns(
        {
            "sanitized_size": F.octet_length("output").cast("bigint"),
            "output_sha256": sha256_hex(F.col("output")),
        }
    )


def verdicts(inspected: DataFrame) -> DataFrame:
    """One row per file: counts, highest severity, sizes and digest of the output."""
    return inspected.select(
        "file_id", "original_type", "status", "original_size",
        F.octet_length("output").cast("bigint").alias("sanitized_size"),
        F.size("findings").alias("n_findings"), max_severity(F.col("findings")).alias("max_severity"),
        "error_message", sha256_hex(F.col("output")).alias("output_sha256"), "output",
    )


def digest_groups(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per distinct content: its digest, lowest file id and number of copies.

    Only digests are shuffled, and they are counted before the shuffle, so many copies cost nothing.
    """
    return files.select("file_id", sha256_hex(F.col(content).cast("binary")).alias("sha256")).groupBy("sha256").agg(
        F.min("file_id").alias("file_id"), F.count(F.lit(1)).alias("copies")
    )


def unseen_digests(groups: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct contents whose digest is not in ``seen(sha256)``."""
    return groups.join(seen.select("sha256"), "sha256", "left_anti")


def audit_log(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One JSON line per request, joined on ``file_id``; fields without a value are left out, as for a request that was rejected."""
    fields = ("request_id", "trace_parent", "profile", "mode", "policy_version")
    present = [c for c in fields if c in requests.columns]
    rows = requests.select("file_id", *present).join(
        outcomes.select("file_id", F.col("original_type").alias("type"), "status", F.col("n_findings").alias("threats")),
        "file_id", "left",
    )
    line = F.to_json(
        F.struct(F.lit("file sanitized").alias("msg"), *present, "type", "status", "threats")
    )
    return rows.select("file_id", line.alias("line"))


def verdict_json(inspected: DataFrame) -> DataFrame:
    """Verdict and findings as one JSON object per file; an empty error is left out."""
    return inspected.select(
        "file_id",
        F.to_json(
            F.struct(
                F.lower("status").alias("status"), "original_type", "original_size",
                F.coalesce(F.octet_length("output"), F.lit(0)).alias("sanitized_size"),
                F.col("findings").alias("threats"), "error_message",
            )
        ).alias("line"),
    )
