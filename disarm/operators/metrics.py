"""Counters and histograms over verdicts. Every group is counted per partition before it is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm import rules
from disarm.operators.verdicts import status_label


def stats_snapshot(verdicts: DataFrame) -> DataFrame:
    """Files, findings and one counter per status."""
    counters = {"files_sanitized": "SANITIZED", "files_clean": "CLEAN", "files_blocked": "BLOCKED",
                "files_errored": "ERROR", "files_unsupported": "UNSUPPORTED"}
    return verdicts.agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.coalesce(F.sum("n_findings"), F.lit(0)).cast("bigint").alias("threats_removed"),
        *[F.count_if(F.col("status") == s).alias(name) for name, s in counters.items()],
    )


def files_processed(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(F.col("original_type").alias("type"), status_label(F.col("status")).alias("result")).agg(
        F.count(F.lit(1)).alias("files")
    )


def files_by_profile(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("profile", "mode", "status").agg(F.count(F.lit(1)).alias("files"))


def threats_removed(findings: DataFrame, by_severity: bool = False) -> DataFrame:
    """Findings per type, optionally rolled up over severity (subtotals have a null severity)."""
    keys = findings.rollup("type", "severity") if by_severity else findings.groupBy("type")
    counted = keys.agg(F.count(F.lit(1)).alias("threats"))
    return counted.where("type IS NOT NULL") if by_severity else counted


def histogram(df: DataFrame, value: Column, bounds: tuple, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative counts per upper bound, with every bound present, plus count and sum.

    One pass: all bounds are counted side by side and then turned into rows. The sum adds
    thousandths, each value cut to a whole number of them.
    """
    counts = [F.count_if(value <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    base = df.groupBy(*keys).agg(
        *counts,
        F.count(value).alias("count"),
        F.coalesce(F.sum((value * 1000).cast("bigint")), F.lit(0)).alias("sum_milli"),
    )
    rows = F.array(
        *[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    )
    return base.select(*keys, F.explode(rows).alias("r"), "count", "sum_milli").select(
        *keys, "r.le", "r.cumulative", "count", "sum_milli"
    )


def duration_histogram(verdicts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return histogram(verdicts, F.col("duration_s"), rules.DURATION_BOUNDS, keys)


def size_histogram(verdicts: DataFrame) -> DataFrame:
    return histogram(verdicts, F.col("original_size"), rules.SIZE_BOUNDS)


def last_error(verdicts: DataFrame, as_of_ts: Column) -> DataFrame:
    """The latest error and its age in whole seconds."""
    failed = F.col("status") == "ERROR"
    return verdicts.agg(
        F.max_by(F.when(failed, F.col("error_message")), F.when(failed, F.struct("ts", "event_id"))).alias("last_error"),
        F.round(as_of_ts.cast("double") - F.max(F.when(failed, F.col("ts"))).cast("double")).cast("bigint").alias("age_s"),
    )


def _labelled(name: str, labels: list[tuple[str, Column]], value: Column) -> Column:
    inner = reduce(
        lambda acc, item: [*acc, F.lit(("," if acc else "") + item[0] + '="'), item[1], F.lit('"')], labels, []
    )
    return F.concat(F.lit(name + "{"), *inner, F.lit("} "), value.cast("string"))


def exposition_lines(
    files: DataFrame, threats: DataFrame, durations: DataFrame, sizes: DataFrame, prefix: str = "disarm"
) -> DataFrame:
    """Metrics in text exposition format, one row per line."""
    duration = f"{prefix}_sanitize_duration_seconds"
    parts = [
        files.select(
            _labelled(f"{prefix}_files_processed_total", [("type", F.col("type")), ("result", F.col("result"))], F.col("files"))
        ),
        threats.select(_labelled(f"{prefix}_threats_removed_total", [("type", F.col("type"))], F.col("threats"))),
        durations.select(_labelled(f"{duration}_bucket", [("le", F.format_string("%.2f", "le"))], F.col("cumulative"))),
        durations.select(F.concat(F.lit(f"{duration}_count "), F.col("count").cast("string"))).distinct(),
        sizes.select(
            _labelled(f"{prefix}_file_size_bytes_bucket", [("le", F.format_string("%.0f", "le"))], F.col("cumulative"))
        ),
    ]
    return reduce(DataFrame.union, parts).toDF("line")


def all_metrics(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """All counters and histograms in one aggregation over one read of each table.

    A row per (kind, type, result), kind being ``file`` or ``threat``, and one with null type and result per kind for the
    totals: ``n``, the number of durations, and how many durations and sizes are within each bound.
    """
    tall = verdicts.select(
        F.lit("file").alias("kind"), F.col("original_type").alias("type"), status_label(F.col("status")).alias("result"),
        F.col("duration_s").cast("double").alias("duration"), F.col("original_size").cast("double").alias("size"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("result", "string"), ("duration", "double"), ("size", "double"))]
    rows = tall.unionByName(findings.select(F.lit("threat").alias("kind"), "type", *nothing))
    within = {f"d{i}": F.count_if(F.col("duration") <= b) for i, b in enumerate(rules.DURATION_BOUNDS)}
    within |= {f"s{i}": F.count_if(F.col("size") <= b) for i, b in enumerate(rules.SIZE_BOUNDS)}
    counted = rows.groupBy("kind", "type", "result").agg(
        F.count(F.lit(1)).alias("n"), F.count("duration").alias("durations"), *[c.alias(name) for name, c in within.items()])
    sums = [F.sum(c).alias(c) for c in ("n", "durations", *within)]
    each, kind = [F.col("kind"), F.col("type"), F.col("result")], [F.col("kind")]
    return counted.groupingSets([each, kind], *each).agg(*sums, F.grouping("type").alias("total"))


def metric_lines(verdicts: DataFrame, findings: DataFrame, prefix: str = "disarm") -> DataFrame:
    """:func:`exposition_lines` from :func:`all_metrics`: each row of it becomes its lines, so nothing is read twice."""
    duration, none = f"{prefix}_sanitize_duration_seconds", F.array().cast("array<string>")
    files = F.array(_labelled(f"{prefix}_files_processed_total", [("type", F.col("type")), ("result", F.col("result"))], F.col("n")))
    threats = F.array(_labelled(f"{prefix}_threats_removed_total", [("type", F.col("type"))], F.col("n")))
    totals = F.array(
        *[_labelled(f"{duration}_bucket", [("le", F.lit(f"{b:.2f}"))], F.col(f"d{i}")) for i, b in enumerate(rules.DURATION_BOUNDS)],
        F.concat(F.lit(f"{duration}_count "), F.col("durations").cast("string")),
        *[_labelled(f"{prefix}_file_size_bytes_bucket", [("le", F.lit(f"{b:.0f}"))], F.col(f"s{i}")) for i, b in enumerate(rules.SIZE_BOUNDS)])
    file, total = F.col("kind") == "file", F.col("total") == 1
    lines = F.when(file & total, totals).when(file, files).when(~total, threats).otherwise(none)
    return all_metrics(verdicts, findings).select(F.explode(lines).alias("line"))
