"""Order-dependent operators against plain loops, on data where one key has most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from disarm.operators import events, ledger, limits
from disarm.operators.ordered import as_of, last_seen, previous_row, streaks


def rows_with_hot_key(n=600, seed=3):
    rng = random.Random(seed)
    # a third of all rows share one key, and many share one time
    return [
        (i, rng.choice([5, rng.randrange(1000)]), "hot" if rng.random() < 0.4 else f"k{rng.randrange(12)}", rng.random() < 0.6)
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def data(spark):
    rows = rows_with_hot_key()
    return rows, spark.createDataFrame(rows, "id LONG, ts LONG, key STRING, hit BOOLEAN")


def in_order(rows, key=None):
    return sorted((r for r in rows if key is None or r[2] == key), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("keys", [["key"], []])
def test_previous_last_and_streak(data, keys):
    rows, df = data
    groups = {r[2] for r in rows} if keys else {None}
    prev, last, streak = {}, {}, {}
    for g in groups:
        before, seen, run = None, None, 0
        for r in in_order(rows, g):
            prev[r[0]], last[r[0]] = before, seen
            run = run + 1 if r[3] else 0
            streak[r[0]] = run
            before = r[0]
            seen = r[0] if r[3] else seen
    got = previous_row(df, keys, ["ts", "id"], ["id"], "p").select("id", "p.id").collect()
    assert {r[0]: r[1] for r in got} == prev
    got = last_seen(df, keys, ["ts", "id"], F.col("hit"), ["id"], "l").select("id", "l.id").collect()
    assert {r[0]: r[1] for r in got} == last
    got = streaks(df, keys, ["ts", "id"], F.col("hit"), "s").select("id", "s").collect()
    assert {r[0]: r[1] for r in got} == streak


def test_as_of(data, spark):
    rows, df = data
    left = df.where("NOT hit").select("id", "ts", "key")
    right = df.where("hit").select("id", "ts", "key", F.col("id").alias("rid"))
    got = {r[0]: r[1] for r in as_of(left, right, ["key"], "ts", "id", ["rid"], "m").select("id", "m.rid").collect()}
    want = {}
    for r in rows:
        if not r[3]:
            older = [q for q in rows if q[3] and q[2] == r[2] and q[1] <= r[1]]
            want[r[0]] = max(older, key=lambda q: (q[1], q[0]))[0] if older else None
    assert got == want


def limited(rows, places, window):
    want, taken = {}, {}
    for i, s, k in sorted(rows, key=lambda r: (r[1], r[0])):
        held = [t for t in taken.get(k, []) if t > s - window]
        want[i] = len(held) < places
        taken[k] = held + [s] if want[i] else held
    return want


@pytest.mark.parametrize("places", [1, 3])
def test_limiter_equals_the_loop(spark, places):
    rng = random.Random(11)
    rows = [(i, rng.randrange(4000), "hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}") for i in range(500)]
    df = spark.createDataFrame(rows, "event_id LONG, s LONG, key STRING").withColumn("ts", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # a key runs over many batches
    got = limits.rate_limit_decisions(df, places, 600).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.event_id: r.accepted for r in got} == limited(rows, places, 600)


@pytest.mark.parametrize("places, window, span, keys", [
    (1, 600, 40_000, ["hot"]), (3, 600, 40_000, ["hot"]), (10, 3000, 40_000, ["hot"]),
    (1, 20_000, 40_000, ["hot"]), (3, 20_000, 40_000, ["hot"]),  # a window longer than many ranges
    (1, 5, 300, ["hot", "hot", None, "b"]), (3, 50, 2000, ["hot", "hot", None, "b"]),
])
def test_limiter_spreads_hot_keys(spark, monkeypatch, places, window, span, keys):
    rng = random.Random(places * window)
    rows = [(i, rng.choice([rng.randrange(span), 7]) if rng.random() < 0.2 else rng.randrange(span), rng.choice(keys)) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id LONG, s LONG, key STRING").withColumn("ts", F.timestamp_seconds("s"))
    parts = []
    entries = {name: getattr(limits, name) for name in ("_entries_of_one", "_entries_of_many")}
    for name, made in entries.items():
        def counted(ranges, *rest, made=made):
            parts.append(ranges.where("key = 'hot'").select("part").distinct().count())
            return made(ranges, *rest)
        monkeypatch.setattr(limits, name, counted)
    got = limits.rate_limit_decisions(df, places, window, hot_rows=60).collect()
    assert {r.event_id: r.accepted for r in got} == limited(rows, places, window)
    assert parts[0] >= 4


def one_hot_key(spark, n):
    rows = [(i, i * 7 % 5 + 40 * i, "hot") for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id LONG, s LONG, key STRING").withColumn("ts", F.timestamp_seconds("s"))


@pytest.mark.parametrize("places, longest", [(1, 10**6), (1, 20), (3, 10**6), (3, 250)])
def test_limiter_over_many_ranges_that_never_meet(spark, monkeypatch, places, longest):
    """Ranges follow the rows, not the limit of a hot key; jobs don't follow the ranges; what finds the entries is cleared."""
    rows, df = one_hot_key(spark, 1500)
    monkeypatch.setattr(limits, "RANGE_ROWS", longest)  # of functions that are put together, and of rows run in one job
    parts, staged = [], []
    monkeypatch.setattr(limits, "stage", lambda d, label, *by, made=limits.stage: staged.append(label) or made(d, label, *by))
    monkeypatch.setattr(limits, "_links", lambda r, made=limits._links: parts.append(r.select("part").distinct().count()) or made(r))
    kept = limits.mark()
    got = limits.rate_limit_decisions(df, places, 8000, hot_rows=10)
    assert limits.mark() == kept + 1  # the ranges
    assert {r.event_id: r.accepted for r in got.collect()} == limited(rows, places, 8000)
    assert 4 <= parts[0] <= 8 and "limited" not in staged and len(staged) <= 5


def test_steps_and_their_composition():
    rng = random.Random(6)
    for _ in range(200):
        at = sorted(rng.randrange(60) for _ in range(rng.randint(2, 25)))
        window, cut = rng.randint(1, 30), rng.randrange(1, len(at))
        first, then = (limits._steps(limits.np.array(a), window) for a in (at[:cut], at[cut:]))
        for t in range(at[0] - 3, at[0] + window + 1):
            now = t
            for x in at:
                now = x + window if x >= now else now
            assert limits._apply(*limits._compose(first, then), limits.np.array([t]))[0] == now


def moments(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_ledger_rules(spark):
    events_ = moments(spark, [
        (1, 10, "a", "add"), (2, 11, "b", "add"), (3, 12, "c", "add"), (4, 20, "b", "revoke"), (5, 21, "b", "revoke"),
        (6, 22, "x", "revoke"), (7, 30, "b", "add"),
    ], "event_id LONG, s LONG, fingerprint STRING, action STRING")
    changed = {r.event_id: r.changed for r in ledger.ledger_changes(events_).collect() if r.action == "revoke"}
    assert changed == {4: True, 5: False, 6: False}
    folded = {r.fingerprint: r.revoked_at for r in ledger.ledger_fold(ledger.ledger_changes(events_)).collect()}
    assert folded == {"a": None, "b": None, "c": None}
    early = events_.where("event_id < 7")
    book = ledger.ledger_fold(ledger.ledger_changes(early))
    assert ledger.ledger_active_count(book, F.timestamp_seconds(F.lit(100))).first()[0] == 2
    nuke = moments(spark, [(50, 25)], "event_id LONG, s LONG")
    assert ledger.revoke_all_counts(early, nuke).first().newly_revoked == 2
    after = {r.fingerprint: r.revoked_at and r.revoked_at.second for r in ledger.ledger_fold(ledger.ledger_changes(events_, nuke), revocations=nuke).collect()}
    assert after == {"a": 25, "b": None, "c": 25}
    issued = events_.select("event_id", "ts", F.col("fingerprint").alias("token"), F.lit("issue").alias("action"))
    for given, live in ((None, 4), (nuke, 1)):
        assert events.live_tokens(issued, F.timestamp_seconds(F.lit(100)), revocations=given).first().live_tokens == live


def test_tokens(spark):
    rows = moments(spark, [
        (1, 0, "t", "issue"), (2, 5, "t", "attempt"), (3, 6, "t", "attempt"), (4, 0, "old", "issue"),
        (5, 200, "old", "attempt"), (6, 201, "old", "attempt"), (7, 1, "none", "attempt"), (8, 0, "edge", "issue"), (9, 100, "edge", "attempt"),
    ], "event_id LONG, s LONG, token STRING, action STRING")
    got = {r.event_id: r.outcome for r in events.token_redemption(rows, ttl_s=100).collect()}
    assert got == {2: "ok", 3: "invalid", 5: "expired", 6: "invalid", 7: "invalid", 9: "ok"}


def test_pins(spark):
    turns = moments(spark, [(1, 0, "A", 0), (2, 100, "B", 1), (3, 200, "C", 1)], "event_id LONG, s LONG, fingerprint STRING, grace_hours INT")
    tries = moments(spark, [(10, 300, "C"), (11, 300, "B"), (12, 300, "A"), (13, 3800, "B"), (14, 150, "A")], "event_id LONG, s LONG, fingerprint STRING")
    got = {r.event_id: r.accepted for r in events.pin_acceptance(tries, turns).collect()}
    assert got == {10: True, 11: True, 12: False, 13: False, 14: True}
    shown = {r.event_id: r.previous_fp for r in events.pin_snapshot(tries, turns).collect()}
    assert shown[13] == "B" and shown[14] == "A"
    hard = moments(spark, [(1, 0, "A", 0), (2, 100, "B", 0)], "event_id LONG, s LONG, fingerprint STRING, grace_hours INT")
    assert not events.pin_acceptance(moments(spark, [(9, 101, "A")], "event_id LONG, s LONG, fingerprint STRING"), hard).first().accepted


def test_expiry_days(spark):
    certs = spark.createDataFrame([(1, -3600), (2, -90000), (3, 86400 * 13), (4, 86400 * 14)], "id LONG, left LONG").withColumn(
        "not_after", F.timestamp_seconds(F.col("left") + 1_000_000)
    )
    got = {r.id: (r.days_remaining, r.health) for r in ledger.cert_expiry(certs, F.timestamp_seconds(F.lit(1_000_000))).collect()}
    assert got == {1: (0, "warn"), 2: (-1, "expired"), 3: (13, "warn"), 4: (14, "ok")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_evictions_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3000) // 10 * 10, rng.choice([0, 1, 40, 90, None]) if rng.random() < 0.95 else 500) for i in range(200)]
    df = moments(spark, [(i, s, z) for i, s, z in rows], "id LONG, s LONG, size LONG").withColumnRenamed("ts", "created_at")
    end, age, items, cap = 2500, 170, 12, 400
    live, gone = [], {}
    for now, i, size in sorted((s, i, z or 0) for i, s, z in rows if s <= end):
        while live and live[0][0] + age < now:
            old = live.pop(0)
            gone[old[1]] = (old[0] + age, None, "age")
        live.append((now, i, size))
        while len(live) > items:
            gone[live.pop(0)[1]] = (now, i, "count")
        while live and sum(x[2] for x in live) > cap:
            gone[live.pop(0)[1]] = (now, i, "bytes")
    for at, i, _ in live:
        gone[i] = (at + age, None, "age") if at + age < end else (None, None, None)
    got = events.download_evictions(df, F.timestamp_seconds(F.lit(end)), age, items, cap)
    rows_ = got.select("id", F.unix_seconds("evicted_at"), "evicted_by", "cause").collect()
    assert {r[0]: tuple(r)[1:] for r in rows_} == gone and len(rows_) == len(gone)
    assert {"age", "count", "bytes", None} == {r.cause for r in rows_}
