"""The client ledger: folding its events, status at a moment, listing, and the revocation gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm import rules
from disarm.operators.ordered import as_of, previous_row


def ledger_changes(events: DataFrame, revocations: DataFrame | None = None) -> DataFrame:
    """Each revoke event with ``changed``: whether it hit a known, unrevoked fingerprint.

    ``events(event_id, ts, fingerprint, action)`` with actions ``add`` and ``revoke``. The state before an
    event is told by the event just before it. ``revocations(event_id, ts)`` revoke every fingerprint.
    """
    rows = previous_row(
        events.select("event_id", "ts", "fingerprint", "action"), ["fingerprint"], ["ts", "event_id"], ["ts", "action"]
    )
    active = F.coalesce(F.col("previous.action") == "add", F.lit(False))
    if revocations is not None:
        rows = as_of(rows, revocations.select("event_id", "ts"), [], "ts", "event_id", ["ts"], "cleared")
        active = active & (F.col("cleared").isNull() | (F.col("cleared.ts") < F.col("previous.ts")))
    return rows.select(
        "event_id", "ts", "fingerprint", "action", ((F.col("action") == "revoke") & active).alias("changed")
    )


def revoke_all_counts(events: DataFrame, revocations: DataFrame) -> DataFrame:
    """How many fingerprints each revoke-everything event newly revoked.

    A fingerprint counts where its latest earlier event is an add that no other such event has cleared:
    the add's next own event comes later, so the add is matched to the first revocation after it.
    """
    flip = lambda d: d.withColumn("_back", -F.unix_micros("ts"))
    reverse = flip(events.select("event_id", "ts", "fingerprint", "action")).withColumn("_tie", -F.col("event_id"))
    nexts = previous_row(reverse, ["fingerprint"], ["_back", "_tie"], ["ts"], "following").where("action = 'add'")
    backwards = flip(revocations.select("event_id", "ts")).withColumn("_tie", -F.col("event_id"))
    matched = as_of(nexts, backwards, [], "_back", "_tie", ["event_id", "ts"], "cleared")
    hit = matched.where(
        F.col("cleared").isNotNull()
        & (F.col("following").isNull() | (F.col("following.ts") > F.col("cleared.ts")))
    )
    counts = hit.groupBy(F.col("cleared.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("newly_revoked"))
    return revocations.select("event_id").join(counts, "event_id", "left").select(
        "event_id", F.coalesce("newly_revoked", F.lit(0)).alias("newly_revoked")
    )


def ledger_fold(
    changes: DataFrame, lifetime_days: int | None = None, revocations: DataFrame | None = None
) -> DataFrame:
    """The ledger after all events: latest add per fingerprint and the revocation that followed it, if any.

    A later add overwrites the record and clears a revocation. ``revocations(event_id, ts)`` revoke every
    fingerprint added by then; ``changes`` must have been told of them too.
    """
    folded = changes.groupBy("fingerprint").agg(
        F.max(F.when(F.col("action") == "add", F.struct("ts", "event_id"))).alias("added"),
        F.max(F.when(F.col("changed"), F.struct("ts", "event_id"))).alias("revoked"),
    ).where("added IS NOT NULL")
    not_after = F.lit(None).cast("timestamp")
    if lifetime_days is not None:
        not_after = F.col("added.ts") + F.make_dt_interval(days=F.lit(lifetime_days))
    own = F.when(F.col("revoked") > F.col("added"), F.col("revoked.ts"))
    if revocations is None:
        return folded.select("fingerprint", F.col("added.ts").alias("issued_at"), not_after.alias("not_after"), own.alias("revoked_at"))
    # seen backwards, the first revocation at or after an add is the latest one before it
    back = -F.unix_micros("ts")
    rows = folded.select("fingerprint", F.col("added.ts").alias("ts"), not_after.alias("not_after"), own.alias("own"), (-F.col("added.event_id")).alias("_tie"))
    matched = as_of(
        rows.withColumn("_back", back), revocations.select("event_id", "ts").withColumn("_back", back).withColumn("_tie", -F.col("event_id")),
        [], "_back", "_tie", ["ts"], "cleared")
    return matched.select(
        "fingerprint", F.col("ts").alias("issued_at"), "not_after", F.least("own", "cleared.ts").alias("revoked_at"))


def ledger_status(as_of_ts: Column) -> Column:
    """``revoked``, ``expired`` or ``active``, in this precedence, from the ledger's columns."""
    return (
        F.when(F.col("revoked_at").isNotNull(), "revoked")
        .when(F.col("not_after") <= as_of_ts, "expired")
        .otherwise("active")
    )


def ledger_active_count(ledger: DataFrame, as_of_ts: Column) -> DataFrame:
    return ledger.agg(F.count_if(ledger_status(as_of_ts) == "active").alias("active_clients"))


def ledger_list(ledger: DataFrame, as_of_ts: Column, include_all: bool = False) -> DataFrame:
    """Records with their status, newest issue first; only active ones unless all are asked for."""
    rows = ledger.withColumn("status", ledger_status(as_of_ts))
    if not include_all:
        rows = rows.where("status = 'active'")
    return rows.orderBy(F.desc("issued_at"), "fingerprint")


def revocation_gate(attempts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Deny attempts whose fingerprint is known and revoked; unknown and expired ones pass here."""
    revoked = ledger.select("fingerprint", F.col("revoked_at").isNotNull().alias("revoked"))
    rows = attempts.join(revoked, "fingerprint", "left")
    return rows.select("event_id", "fingerprint", (~F.coalesce("revoked", F.lit(False))).alias("allowed"))


def days_remaining(not_after: Column, as_of_ts: Column) -> Column:
    """Whole days left, truncated toward zero."""
    seconds = F.unix_seconds(not_after) - F.unix_seconds(as_of_ts)
    return F.call_function("div", seconds, F.lit(86400).cast("bigint"))


def cert_expiry(certs: DataFrame, as_of_ts: Column) -> DataFrame:
    """Days left, health (``ok``, ``warn``, ``expired``) with its exit code, and days clamped at zero."""
    rows = certs.withColumn("days_remaining", days_remaining(F.col("not_after"), as_of_ts))
    days = F.col("days_remaining")
    return rows.withColumns(
        {
            "health": F.when(days < 0, "expired").when(days < rules.CERT_WARN_DAYS, "warn").otherwise("ok"),
            "exit_code": F.when(days < 0, 2).when(days < rules.CERT_WARN_DAYS, 1).otherwise(0),
            "days_until_expiry": F.greatest(days, F.lit(0).cast("bigint")),
        }
    )
