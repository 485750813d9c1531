"""Order-dependent columns that hold up when one key has most of the rows.

A window over a hot key, or over no key at all, would pull every row of it into one task. Here the
rows are cut into ranges of (keys, order) instead, so a hot key is spread over many ranges. Columns are
first computed inside a range; one small summary row per range and key then carries the state from
range to range. The number of ranges follows the row count, two million rows each at most, so a key that holds
all of 10^11 rows has 50,000 summaries.

``order`` must be unique within a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disarm.staging import range_width, stage

Local = Callable[[DataFrame, WindowSpec], DataFrame]


def cut_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], local: Local) -> DataFrame:
    """Rows with ``_part`` and whatever ``local`` adds over the rows of one range and key; staged."""
    rows = stage(df, "unordered")
    parted = rows.repartitionByRange(range_width(rows, rows.count()), *keys, *order).withColumn(
        "_part", F.spark_partition_id()
    )
    within = W.partitionBy("_part", *keys).orderBy(*order)
    return stage(local(parted, within), "ranges")


def attach(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the carried state of each range and key onto its rows; missing keys count as equal."""
    on = ["_part", *keys]
    renamed = carried.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in carried.columns if c not in on])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on])
    return rows.join(renamed, match).drop(*[f"_k_{c}" for c in on])


def _across(keys: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy("_part")


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], into: str = "previous"
) -> DataFrame:
    """Add a struct of the columns of the row just before, in order, within the key; null for the first."""
    value = F.struct(*columns)
    rows = cut_ranges(df, keys, order, lambda d, w: d.withColumn("_local", F.lag(value).over(w)))
    last = rows.groupBy("_part", *keys).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select("_part", *keys, F.lag("_last").over(_across(keys)).alias("_carry"))
    return attach(rows, carried, keys).withColumn(into, F.coalesce("_local", "_carry")).drop("_part", "_local", "_carry")


def last_seen(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], seen: Column, columns: Sequence[str], into: str
) -> DataFrame:
    """Add a struct of the columns of the latest earlier row for which ``seen`` holds."""
    value = F.when(seen, F.struct(*columns))
    rows = cut_ranges(
        df, keys, order,
        lambda d, w: d.withColumn("_value", value).withColumn(
            "_local", F.last("_value", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
        ),
    )
    last = rows.groupBy("_part", *keys).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last")
    )
    carried = last.select(
        "_part", *keys,
        F.last("_last", ignorenulls=True)
        .over(_across(keys).rowsBetween(W.unboundedPreceding, -1))
        .alias("_carry"),
    )
    return (
        attach(rows, carried, keys)
        .withColumn(into, F.coalesce("_local", "_carry"))
        .drop("_part", "_value", "_local", "_carry")
    )


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, tie: str, columns: Sequence[str], into: str
) -> DataFrame:
    """For each left row the latest right row at or before it: a struct of ``columns``, or null.

    Both sides have ``time`` and the tie-breaker ``tie``; at equal times a right row comes first.
    """
    padded_left = left.select("*", F.lit(1).alias("_side"), *[
        F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in columns
    ])
    padded_right = right.select(
        *[
            F.col(c) if c in (*keys, time, tie) else F.lit(None).cast(left.schema[c].dataType).alias(c)
            for c in left.columns
        ],
        F.lit(0).alias("_side"), *[F.col(c).alias(f"_r_{c}") for c in columns],
    )
    both = padded_left.unionByName(padded_right)
    names = [f"_r_{c}" for c in columns]
    found = last_seen(both, keys, [time, "_side", tie], F.col("_side") == 0, names, "_found").where("_side = 1")
    value = F.struct(*[F.col(f"_found._r_{c}").alias(c) for c in columns])
    return found.withColumn(into, F.when(F.col("_found").isNotNull(), value)).drop("_side", "_found", *names)


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, into: str = "streak") -> DataFrame:
    """Add the number of hits in a row that end at each row; any other row makes it zero."""
    rows = cut_ranges(
        df, keys, order,
        lambda d, w: d.withColumn("_hit", F.coalesce(hit, F.lit(False)))
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("_reset", F.max(F.when(~F.col("_hit"), F.col("_rn"))).over(w)),
    )
    summary = rows.groupBy("_part", *keys).agg(F.max("_rn").alias("_n"), F.max("_reset").alias("_last_reset"))
    before = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    trailing = F.col("_n") - F.coalesce("_last_reset", F.lit(0))
    summed = summary.withColumn("_sum", F.coalesce(F.sum(trailing).over(before), F.lit(0)))
    # hits of the ranges since, and including, the last one with a reset
    since = F.last(F.when(F.col("_last_reset").isNotNull(), F.col("_sum")), ignorenulls=True).over(before)
    carried = summed.select("_part", *keys, (F.col("_sum") - F.coalesce(since, F.lit(0))).alias("_carry"))
    length = F.when(F.col("_reset").isNotNull(), F.col("_rn") - F.col("_reset")).otherwise(F.col("_rn") + F.col("_carry"))
    return attach(rows, carried, keys).withColumn(into, length.cast("bigint")).drop(
        "_part", "_hit", "_rn", "_reset", "_carry"
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rank: str = "rank", total: str = "total") -> DataFrame:
    """Add the number of rows and the sum of ``value`` up to and including each row; null values count as zero."""
    amount = F.coalesce(F.col(value), F.lit(0))
    rows = cut_ranges(
        df, keys, order,
        lambda d, w: d.withColumn(rank, F.row_number().over(w).cast("bigint")).withColumn(total, F.sum(amount).over(w.rowsBetween(W.unboundedPreceding, 0))),
    )
    summary = rows.groupBy("_part", *keys).agg(F.max(rank).alias("_n"), F.sum(amount).alias("_sum"))
    before = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        "_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum"))
    return attach(rows, carried, keys).withColumns({rank: F.col(rank) + F.col("_n"), total: F.col(total) + F.col("_sum")}).drop("_part", "_n", "_sum")
