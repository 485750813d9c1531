"""Streams whose rows arrive out of order, over several micro-batches, against the batch forms over all rows."""

import random
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from disarm.operators import events, limits
from disarm.streaming import queries as sq
from disarm.streaming import stateful as ss

LATE = 900  # seconds that a row may be late


def fresh():
    return tempfile.mkdtemp(prefix="spark-")


def moment(s):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)


def arriving(spark, rows, schema, batches, quiet):
    """``rows(event_id, second, …)`` as a stream: each up to ``LATE`` late, and then a row so long after that all else is decided."""
    rng = random.Random(5)
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, LATE - 1))
    path, width = fresh(), -(-len(order) // batches)
    parts = [order[i:i + width] for i in range(0, len(order), width)]
    parts.append([(-1, max(r[1] for r in rows) + quiet, *quiet_row(schema))])
    for part in parts:
        frame = spark.createDataFrame([(r[0], moment(r[1]), *r[2:]) for r in part], f"event_id long, ts timestamp, {schema}")
        frame.coalesce(1).write.mode("append").parquet(path)
    return sq.stream_table(spark, path, max_files=1)


def quiet_row(schema):
    return ["quiet"] * len(schema.split(", "))


def run(stream):
    """The rows that come out, rows dropped as too late, and rows of state left."""
    out = fresh()
    with ss.state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh()).trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
    left = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    return stream.sparkSession.read.schema(stream.schema).parquet(out).collect(), dropped, left


def batch(spark, rows, schema):
    return spark.createDataFrame([(r[0], moment(r[1]), *r[2:]) for r in rows], f"event_id long, ts timestamp, {schema}")


def test_limiter(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(20_000), rng.choice(["hot", "hot", "b", "c", None])) for i in range(400)]
    want = {tuple(r) for r in limits.rate_limit_decisions(batch(spark, rows, "key string"), 3, 1200).collect()}
    got, dropped, left = run(ss.rate_limit_stream(arriving(spark, rows, "key string", 4, 9000), 3, 1200, f"{LATE} seconds"))
    assert {tuple(r) for r in got} == want and len(got) == len(rows) and not dropped
    assert left <= 4  # the row that moved the watermark still waits; nothing else is kept


def test_streaks(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(9000), rng.choice("xy"), rng.choice(["ERROR", "ERROR", "CLEAN", None])) for i in range(300)]
    schema = "original_type string, status string"
    want = {tuple(r) for r in events.error_streaks(batch(spark, rows, schema), 3).collect()}
    got, dropped, _ = run(ss.error_streak_stream(arriving(spark, rows, schema, 3, 9000), 3, f"{LATE} seconds"))
    assert {tuple(r) for r in got} == want and want and not dropped


def tokens(n=500):
    rng = random.Random(3)
    rows = [(i, rng.randrange(30_000) // 7 * 7, rng.choice([None, *"abcdefghij"]), rng.choice(["issue", "attempt"])) for i in range(n)]
    nukes = [(1000 + i, t, None, "revoke_all") for i, t in enumerate((0, 3_003, 12_000, 12_001, rows[0][1], rows[1][1]))]
    return rows, nukes


@pytest.mark.parametrize("shards", [1, 5])
def test_tokens_revoked_and_forgotten(spark, shards):
    rows, nukes = tokens()
    schema = "token string, action string"
    want = {tuple(r) for r in events.token_redemption(
        batch(spark, rows, schema), 700, batch(spark, nukes, schema).select("event_id", "ts"), forget_s=400).collect()}
    assert {r[2] for r in want} == {"ok", "expired", "invalid"}
    stream = arriving(spark, rows + nukes, schema, 3, 9000)
    got, dropped, left = run(ss.token_stream(stream, 700, 400, f"{LATE} seconds", shards))
    assert {tuple(r) for r in got} == want and len(got) == len(want) and not dropped
    assert left <= 3  # the quiet row and when it is due


def test_rows_later_than_that_are_counted(spark):
    path = fresh()
    # Spark takes rows of the batch after the one that moved the watermark; from then on they are late
    for part in ([(2, 9000, "a")], [(4, 9001, "b")], [(1, 10, "a")], [(3, 20_000, "a")]):
        batch(spark, part, "key string").coalesce(1).write.mode("append").parquet(path)
    got, dropped, _ = run(ss.rate_limit_stream(sq.stream_table(spark, path, max_files=1), 1, 60, f"{LATE} seconds"))
    assert dropped == 1 and {r.event_id for r in got} == {2, 4}


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with ss.state_store(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == ss.ROCKSDB
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def grouped_by(stream):
    """The plan above the watermark, with the columns that rows of keyed state are grouped by."""
    plan = stream._jdf.queryExecution().analyzed().toString()
    return plan[:plan.index("EventTimeWatermark")]


def test_keys_of_the_limiter_are_dealt_to_shards(spark):
    """A key of its own costs calls to the store in every micro-batch; keys that share a shard are still decided alone."""
    rng = random.Random(8)
    rows = [(i, rng.randrange(20_000), rng.choice([None, *range(90)])) for i in range(900)]
    want = {tuple(r) for r in limits.rate_limit_decisions(batch(spark, rows, "key long"), 2, 3000).collect()}
    stream = ss.rate_limit_stream(arriving_keys(spark, rows), 2, 3000, f"{LATE} seconds", shards=3)
    assert "shard#" in grouped_by(stream)
    got, dropped, left = run(stream)
    assert {tuple(r) for r in got} == want and len(got) == len(rows) and not dropped
    assert left <= 4


def arriving_keys(spark, rows):
    return arriving(spark, [(i, s, None if k is None else str(k)) for i, s, k in rows], "key string", 4, 9000).withColumn("key", F.expr("try_cast(key AS long)"))


def test_downloads_expire_once(spark):
    """Downloads of a shard share its state and one timer; equal times, nulls and a row whose time is over already each come out."""
    path, schema = fresh(), "id long, created_at timestamp, size long"
    parts = [[(1, 0, 10), (2, 0, None), (3, 30, 2**60 + 1), (4, 700, 5)], [(5, 650, 7), (6, 5000, 1)], [(7, 4990, 3)], [(8, 9000, 4)]]
    for part in parts:
        spark.createDataFrame([(i, moment(s), z) for i, s, z in part], schema).coalesce(1).write.mode("append").parquet(path)
    stream = ss.download_expiry_stream(sq.stream_table(spark, path, max_files=1), 600, "60 seconds", shards=2)
    assert "shard#" in grouped_by(stream)
    got, dropped, _ = run(stream)
    rows = sorted((tuple(r) for r in got), key=lambda r: (r[2], r[0]))
    sizes = {1: 10, 2: None, 3: 2**60 + 1, 4: 5, 5: 7, 6: 1, 7: 3, 8: 4}
    assert rows == [(i, sizes[i], "expired") for i in range(1, 8)] + [(i, sizes[i], "stored") for i in range(1, 9)] and not dropped
