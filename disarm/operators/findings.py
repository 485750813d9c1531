"""The shape of a finding, shared by every format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm import rules
from disarm.schema import FINDING


def finding(kind, location, description, severity) -> Column:
    def col(value):
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        col(kind).alias("type"), col(location).alias("location"),
        col(description).alias("description"), col(severity).alias("severity"),
    )


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in rules.SEVERITIES]), severity)


def max_severity(findings: Column) -> Column:
    """Highest severity in a findings array; null when it is empty."""
    top = F.array_max(F.transform(findings, lambda f: severity_rank(f["severity"])))
    return reduce(
        lambda chain, pair: chain.when(top == pair[0] + 2, pair[1]),
        enumerate(rules.SEVERITIES[1:]),
        F.when(top == 1, rules.SEVERITIES[0]),
    )


def findings_table(inspected: DataFrame) -> DataFrame:
    """One row per finding, ``seq`` keeping the scan order.

    The outer form keeps Spark from testing ``findings`` for being empty in a filter of its own, which would scan each file again.
    """
    rows = inspected.select("file_id", F.posexplode_outer("findings").alias("seq", "f")).where("f IS NOT NULL")
    return rows.select("file_id", "seq", "f.*")
