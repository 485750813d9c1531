"""Event-order rules: error streaks, single-use tokens, pinned fingerprints, download retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disarm import rules
from disarm.operators.ordered import as_of, previous_row, running, streaks
from disarm.staging import stage


def error_streaks(log: DataFrame, threshold: int = rules.STREAK_ALERT) -> DataFrame:
    """Rows at which the errors in a row of one type reach the threshold: one alert per streak."""
    counted = streaks(
        log.select("event_id", "ts", "original_type", "status"), ["original_type"], ["ts", "event_id"],
        F.col("status") == "ERROR",
    )
    return counted.where(F.col("streak") == threshold).select("event_id", "original_type", "streak")


def token_redemption(
    events: DataFrame, ttl_s: int = rules.TOKEN_TTL_S, revocations: DataFrame | None = None, forget_s: int | None = None
) -> DataFrame:
    """Outcome of each attempt to use a single-use token: ``ok``, ``expired`` or ``invalid``.

    ``events(event_id, ts, token, action)`` with actions ``issue`` and ``attempt``. The first attempt after
    an issue decides (an expired one uses the token up too), so only the event just before matters.
    ``revocations(event_id, ts)`` clear every outstanding token. With ``forget_s``, a token is unknown that long after it expired.
    """
    rows = previous_row(
        events.select("event_id", "ts", "token", "action"), ["token"], ["ts", "event_id"], ["ts", "action"]
    ).where("action = 'attempt'")
    known = F.col("previous.action") == "issue"
    columns = ["event_id", "token"]
    if revocations is not None:
        rows = as_of(rows, revocations.select("event_id", "ts"), [], "ts", "event_id", ["ts"], "cleared")
        known = known & (F.col("cleared").isNull() | (F.col("cleared.ts") < F.col("previous.ts")))
    age = F.col("ts").cast("double") - F.col("previous.ts").cast("double")
    if forget_s is not None:
        known = known & (age <= ttl_s + forget_s)
    outcome = F.when(F.coalesce(known, F.lit(False)), F.when(age <= ttl_s, "ok").otherwise("expired")).otherwise("invalid")
    return rows.select(*columns, outcome.alias("outcome"))


def live_tokens(
    events: DataFrame, as_of_ts: Column, ttl_s: int = rules.TOKEN_TTL_S, revocations: DataFrame | None = None
) -> DataFrame:
    """Number of tokens that could still be used at a moment: last event is an issue within its TTL.

    ``revocations(event_id, ts)`` clear every token issued by then.
    """
    last = (
        events.where(F.col("ts") <= as_of_ts)
        .groupBy("token")
        .agg(F.max(F.struct("ts", "event_id", "action")).alias("last"))
    )
    age = as_of_ts.cast("double") - F.col("last.ts").cast("double")
    live = (F.col("last.action") == "issue") & (age <= ttl_s)
    if revocations is not None:
        cleared = revocations.where(F.col("ts") <= as_of_ts).agg(F.max("ts")).first()[0]
        if cleared is not None:
            live = live & (F.col("last.ts") > F.lit(cleared))
    return last.agg(F.count_if(live).alias("live_tokens"))


def pin_states(rotations: DataFrame) -> DataFrame:
    """Current and previous fingerprint, and until when the previous one holds, from each rotation on.

    ``rotations(event_id, ts, fingerprint, grace_hours)``. Only one generation is kept; no grace, or a
    rotation to the same fingerprint, clears it.
    """
    rows = previous_row(rotations, [], ["ts", "event_id"], ["fingerprint"])
    old = F.col("previous.fingerprint")
    keeps = (F.col("grace_hours") > 0) & old.isNotNull() & (old != "") & (old != F.col("fingerprint"))
    return rows.select(
        "event_id", "ts", F.col("fingerprint").alias("current_fp"),
        F.when(keeps, old).alias("previous_fp"),
        F.when(keeps, F.col("ts") + F.make_dt_interval(hours=F.col("grace_hours"))).alias("until"),
    )


def _with_pin(attempts: DataFrame, rotations: DataFrame) -> DataFrame:
    return as_of(
        attempts, pin_states(rotations), [], "ts", "event_id", ["current_fp", "previous_fp", "until"], "pin"
    )


def pin_acceptance(attempts: DataFrame, rotations: DataFrame) -> DataFrame:
    """Whether the fingerprint of each attempt was acceptable then: current, or previous within its grace."""
    rows = _with_pin(attempts, rotations)
    ok = (F.col("fingerprint") == F.col("pin.current_fp")) | (
        (F.col("fingerprint") == F.col("pin.previous_fp")) & (F.col("ts") < F.col("pin.until"))
    )
    return rows.select("event_id", F.coalesce(ok, F.lit(False)).alias("accepted"))


def pin_snapshot(moments: DataFrame, rotations: DataFrame) -> DataFrame:
    """Fingerprints on show at each moment; the previous one is shown up to and including its end."""
    rows = _with_pin(moments, rotations)
    shown = F.col("pin.previous_fp").isNotNull() & (F.col("ts") <= F.col("pin.until"))
    return rows.select(
        "event_id", F.coalesce("pin.current_fp", F.lit("")).alias("current_fp"),
        F.when(shown, F.col("pin.previous_fp")).otherwise("").alias("previous_fp"),
        F.when(shown, F.unix_seconds("pin.until")).otherwise(0).alias("until_unix"),
    )


def download_retention(
    downloads: DataFrame,
    as_of_ts: Column,
    max_age_s: int = rules.DOWNLOAD_MAX_AGE_S,
    max_items: int = rules.DOWNLOAD_MAX_ITEMS,
    max_bytes: int = rules.DOWNLOAD_MAX_BYTES,
) -> DataFrame:
    """Downloads still kept at a moment: not too old, then the newest within the item and byte caps.

    The item cap is a top-k, taken per partition first; the running size then runs over at most
    ``max_items`` rows. Evicting the oldest one at a time leaves the same rows.
    """
    age = as_of_ts.cast("double") - F.col("created_at").cast("double")
    fresh = downloads.where((age >= 0) & (age <= max_age_s)).select("id", "created_at", "size")
    newest = fresh.orderBy(F.desc("created_at"), F.desc("id")).limit(max_items)
    total = F.sum("size").over(
        W.orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(W.unboundedPreceding, 0)
    )
    return newest.withColumn("kept_bytes", total).where(F.col("kept_bytes") <= max_bytes).select("id", "size", "kept_bytes")


def download_evictions(
    downloads: DataFrame,
    as_of_ts: Column,
    max_age_s: int = rules.DOWNLOAD_MAX_AGE_S,
    max_items: int = rules.DOWNLOAD_MAX_ITEMS,
    max_bytes: int = rules.DOWNLOAD_MAX_BYTES,
) -> DataFrame:
    """When and why each download went: ``downloads(id, created_at, size)`` → id, evicted_at, evicted_by, cause.

    Downloads go oldest first: when a newer one makes them too many (``count``) or too large together (``bytes``; one that
    is too large on its own goes at once), or when they are too old (``age``). ``evicted_by`` is the newer one. Those that
    are there at ``as_of_ts`` have nulls; later downloads don't count yet. Downloads of one moment come in the order of their ids.

    What is kept is a run that ends with the newest, so each download's end can be looked up in running totals: the
    download ``max_items`` further on, and the first one at which the bytes since it exceed the cap.
    """
    there = downloads.where(F.col("created_at") <= as_of_ts).select("id", "created_at", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    rows = stage(running(there, [], ["created_at", "id"], "size"), "downloads")
    newer = F.struct(F.col("created_at").alias("at"), F.col("rank"), F.col("id").alias("by"))
    by_count = rows.select((F.col("rank") - max_items).alias("rank"), newer.alias("by_count"))
    # going down the totals, the latest one at or before "bytes before me, plus the cap, plus one" is the first that exceeds it
    over = rows.select((-F.col("total")).alias("_down"), (-F.col("rank")).alias("_tie"), newer.alias("newer"))
    probes = rows.select("id", "created_at", "rank", (F.col("size") - F.col("total") - max_bytes - 1).alias("_down"), (-F.col("rank")).alias("_tie"))
    found = as_of(probes, over, [], "_down", "_tie", ["newer"], "hit").join(by_count, "rank", "left")
    aged = F.col("created_at") + F.make_dt_interval(secs=F.lit(max_age_s))
    nobody = F.lit(None).cast(rows.schema["id"].dataType)

    def end(known: Column, at: Column, rank: Column, kind: int, by: Column) -> Column:
        # at its age a download still stands, so anything at that moment comes first; of one download's causes, count does
        return F.when(known, F.struct(at.alias("at"), F.lit(kind == 2).alias("old"), rank.alias("rank"), F.lit(kind).alias("kind"), by.alias("by")))

    first = F.least(
        end(F.col("by_count").isNotNull(), F.col("by_count.at"), F.col("by_count.rank"), 0, F.col("by_count.by")),
        end(F.col("hit").isNotNull(), F.col("hit.newer.at"), F.col("hit.newer.rank"), 1, F.col("hit.newer.by")),
        end(aged < as_of_ts, aged, F.lit(0).cast("bigint"), 2, nobody))
    causes = F.array(*map(F.lit, ("count", "bytes", "age")))
    return found.withColumn("_end", first).select(
        "id", F.col("_end.at").alias("evicted_at"), F.col("_end.by").alias("evicted_by"), F.get(causes, F.col("_end.kind")).alias("cause"))
