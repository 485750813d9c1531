"""Keyed state: chunk assembly, single-use tokens, the sliding limiter, error streaks, download expiry.

Rules that depend on order decide a row only once the watermark has passed it: until then it waits in the key's state,
so rows may arrive in any order, over any number of micro-batches, as long as they are no later than ``lateness``.
(Spark drops later ones and counts them in the query's progress.) What a key keeps is forgotten by timers.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from disarm import rules

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_LONG = T.StructType().add("v", "long")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store that keyed state needs, for queries started inside; a query copies the session's settings when it starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _run(stream: DataFrame, key: str, processor: StatefulProcessor, out: T.StructType) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


class InOrder(StatefulProcessor):
    """Holds the rows of a key back until the watermark has passed them and then decides them in order.

    ``columns`` are the names and types of the columns that rows wait with, first those that order them; the first of
    all is ``at``, in microseconds. Rows that arrive are only appended; the waiting ones are read when the first
    of them is due.
    """

    columns = "at long, event_id long"
    output: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        # time of the first waiting row, and the timer set
        self.clock = handle.getValueState("clock", "due long, timer long")
        self.names = [c.split()[0] for c in self.columns.split(", ")]
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def decide(self, key, rows: list[tuple]) -> list[tuple]:
        """Output of rows that are next in order."""
        raise NotImplementedError

    def forget(self, watermark: int) -> int | None:
        """Clear what no later row needs; say when, in microseconds, there will be more to clear, or None if nothing is left."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            new = list(batch[self.names].itertuples(index=False, name=None))
            self.waiting.appendList(new)
            first = min(row[0] for row in new) if first is None else min(first, min(row[0] for row in new))
        yield from self._due(key, timerValues, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, timerValues, None)

    def _due(self, key, timer_values, first: int | None) -> Iterator[pd.DataFrame]:
        watermark = timer_values.getCurrentWatermarkInMs() * 1000
        due, timer = self.clock.get() if self.clock.exists() else (None, None)
        due = min((t for t in (due, first) if t is not None), default=None)
        if due is not None and due <= watermark:
            waiting = [tuple(row) for row in self.waiting.get()]
            later = [row for row in waiting if row[0] > watermark]
            self.waiting.put(later) if later else self.waiting.clear()
            due = min((row[0] for row in later), default=None)
            ready = sorted((row for row in waiting if row[0] <= watermark), key=lambda r: r[:self.ordered])
            made = self.decide(key, ready)
            if made:
                yield pd.DataFrame(made, columns=list(self.output))
        again = [t for t in (due, self.forget(watermark)) if t is not None]
        wake = max(math.ceil(min(again) / 1000), watermark // 1000 + 1) if again else None
        if wake != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        self.clock.update((due, wake)) if again else self.clock.clear()

    #: how many of the first columns order rows
    ordered = 2

    def close(self) -> None:
        pass


def _schema(columns: str) -> T.StructType:
    return T.StructType.fromDDL(columns)


class ErrorStreaks(InOrder):
    """Counts errors in a row per type."""

    columns = "at long, event_id long, error boolean"
    output = ("event_id", "original_type", "streak")

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", _LONG)

    def decide(self, key, rows: list[tuple]) -> list[tuple]:
        length = self.count.get()[0] if self.count.exists() else 0
        alerts = []
        for _, event_id, error in rows:
            length = length + 1 if error else 0
            if length == self.threshold:
                alerts.append((event_id, key[0], length))
        self.count.update((length,)) if length else self.count.clear()
        return alerts

    def forget(self, watermark: int) -> None:
        return None  # a streak may go on at any time; it is one number for each type


def error_streak_stream(log: DataFrame, threshold: int = rules.STREAK_ALERT, lateness: str = "1 minute") -> DataFrame:
    """One alert per streak of errors of a type, in event order: ``events.error_streaks`` as a stream."""
    rows = log.withWatermark("ts", lateness).select(
        "ts", "original_type", F.unix_micros("ts").alias("at"), "event_id", F.coalesce(F.col("status") == "ERROR", F.lit(False)).alias("error"))
    return _run(rows, "original_type", ErrorStreaks(threshold), _schema("event_id long, original_type string, streak long"))


class SingleUse(InOrder):
    """Outstanding tokens of one shard, and the time of the latest revocation of all of them."""

    columns = "at long, kind int, event_id long, token string"
    ordered = 3
    output = ("event_id", "token", "outcome")
    OTHER, REVOKE, ISSUE, ATTEMPT = range(4)

    def __init__(self, ttl_s: int, forget_s: int) -> None:
        self.ttl, self.keep = ttl_s * 1_000_000, (ttl_s + forget_s) * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.issued = handle.getMapState("issued", "token string", "at long")
        self.revoked = handle.getValueState("revoked", _LONG)
        self.sweep = handle.getValueState("sweep", _LONG)

    def decide(self, key, rows: list[tuple]) -> list[tuple]:
        revoked = before = self.revoked.get()[0] if self.revoked.exists() else None
        held: dict[str, int | None] = {}  # tokens of these rows, read once
        known: dict[str, int | None] = {}
        outcomes = []
        for at, kind, event_id, token in rows:
            if kind in (self.OTHER, self.REVOKE):
                revoked = at if kind == self.REVOKE else revoked
                continue
            name = "-" if token is None else "+" + token
            if name not in held:
                found = self.issued.getValue((name,)) if self.issued.containsKey((name,)) else None
                held[name] = known[name] = found[0] if found else None
            if kind == self.ISSUE:
                held[name] = at
                continue
            since, held[name] = held[name], None
            lost = since is None or at - since > self.keep or (revoked is not None and revoked >= since)
            outcomes.append((event_id, token, "invalid" if lost else "ok" if at - since <= self.ttl else "expired"))
        for name, since in held.items():
            if since is not None and since != known[name]:
                self.issued.updateValue((name,), (since,))
            elif since is None and known[name] is not None:
                self.issued.removeKey((name,))
        if revoked != before:
            self.revoked.update((revoked,))
        return outcomes

    def forget(self, watermark: int) -> int | None:
        """Tokens are looked through when the oldest one is over; the next look is at least a quarter of their time later."""
        if self.sweep.exists() and self.sweep.get()[0] > watermark:
            return self.sweep.get()[0]
        revoked = self.revoked.get()[0] if self.revoked.exists() else None
        oldest = None
        for name, since in [(k[0], v[0]) for k, v in self.issued.iterator()]:
            if watermark - since > self.keep or revoked is not None and revoked >= since:
                self.issued.removeKey((name,))
            else:
                oldest = since if oldest is None else min(oldest, since)
        if oldest is None:
            self.sweep.clear()
            # a revocation of the past only matters to tokens issued before it
            self.revoked.clear()
            return None
        again = max(oldest + self.keep + 1, watermark + self.keep // 4)
        self.sweep.update((again,))
        return again


def token_stream(
    events: DataFrame, ttl_s: int = rules.TOKEN_TTL_S, forget_s: int = rules.TOKEN_TTL_S, lateness: str = "1 minute", shards: int = 64
) -> DataFrame:
    """``events.token_redemption`` as a stream: the outcome of each attempt to use a token.

    ``events(event_id, ts, token, action)`` with actions ``issue``, ``attempt`` and ``revoke_all``; others only move the
    watermark. Tokens are dealt to shards, and a ``revoke_all`` goes to each of them, so it meets all tokens at its place in
    event order. A token that is not used is forgotten ``forget_s`` after it expired; until then it is ``expired``.
    """
    kind = F.when(F.col("action") == "revoke_all", SingleUse.REVOKE).when(F.col("action") == "issue", SingleUse.ISSUE).when(F.col("action") == "attempt", SingleUse.ATTEMPT)
    kind = kind.otherwise(SingleUse.OTHER)  # not filtered: a filter would go below the watermark
    dealt = F.array(F.pmod(F.xxhash64("token"), F.lit(shards)).cast("int"))
    rows = events.withWatermark("ts", lateness).select(
        "ts", F.unix_micros("ts").alias("at"), kind.alias("kind"), "event_id", "token",
        F.explode(F.when(F.col("action") == "revoke_all", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(dealt)).alias("shard"))
    return _run(rows, "shard", SingleUse(ttl_s, forget_s), _schema("event_id long, token string, outcome string"))


class SlidingLimit(InOrder):
    """Keeps the times of accepted events of one shard of the keys that are still in the window: at most ``max_events`` of a key."""

    columns = "at long, event_id long, name string"
    output = ("event_id", "accepted")

    def __init__(self, max_events: int, window_s: int) -> None:
        self.max_events, self.window = max_events, window_s * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "name string, at long")
        # when the first of them leaves the window
        self.first = handle.getValueState("first", _LONG)

    def _keep(self, held: list[tuple[str, int]]) -> int | None:
        if not held:
            self.accepted.clear()
            self.first.clear()
            return None
        self.accepted.put(held)
        first = min(t for _, t in held) + self.window
        self.first.update((first,))
        return first

    def decide(self, key, rows: list[tuple]) -> list[tuple]:
        held: dict[str, deque] = {}
        if self.first.exists():
            for name, t in self.accepted.get():
                held.setdefault(name, deque()).append(t)
        verdicts = []
        for at, event_id, name in rows:
            taken = held.get(name)
            if taken is None:
                taken = held[name] = deque()
            while taken and taken[0] <= at - self.window:
                taken.popleft()
            verdicts.append((event_id, len(taken) < self.max_events))
            if verdicts[-1][1]:
                taken.append(at)
        # what no later row of any key can see any more goes at once
        end = rows[-1][0] - self.window
        self._keep([(name, t) for name, taken in held.items() for t in taken if t > end])
        return verdicts

    def forget(self, watermark: int) -> int | None:
        first = self.first.get()[0] if self.first.exists() else None
        if first is None or first > watermark:
            return first
        return self._keep([(name, t) for name, t in self.accepted.get() if t + self.window > watermark])


def rate_limit_stream(
    events: DataFrame, max_events: int, window_s: int = rules.LIMIT_WINDOW_S, lateness: str = "1 minute", shards: int = 64
) -> DataFrame:
    """``limits.rate_limit_decisions`` as a stream; a null key is a key of its own. Keys are dealt to shards, as each key of its own
    would cost calls to the state store in every micro-batch."""
    rows = events.withWatermark("ts", lateness).select("ts", F.to_json(F.struct("key")).alias("name"), F.unix_micros("ts").alias("at"), "event_id")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int"))
    return _run(dealt, "shard", SlidingLimit(max_events, window_s), _schema("event_id long, accepted boolean"))


class ChunkAssembly(StatefulProcessor):
    """Gathers the chunks of an upload until its last one; over the cap, or half done for too long, it is rejected."""

    def __init__(self, max_size: int, timeout_ms: int) -> None:
        self.max_size, self.timeout_ms = max_size, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", T.StructType().add("seq", "integer"), T.StructType().add("chunk", "binary"))
        # bytes so far and the number of the last chunk (-1 until it is known); a size of -1 marks a rejected upload
        self.progress = handle.getValueState("progress", T.StructType().add("size", "long").add("last", "integer").add("n", "integer"))

    def _stop_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _restart_timer(self, latest: int) -> None:
        self._stop_timers()
        self.handle.registerTimer(latest + self.timeout_ms)

    def _result(self, key, content, size, reason) -> pd.DataFrame:
        return pd.DataFrame({"request_id": [key[0]], "content": [content], "size": [size], "reject_reason": [reason]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, last, n = self.progress.get() if self.progress.exists() else (0, -1, 0)
        latest = 0
        for batch in rows:
            if size < 0:
                continue
            for row in batch.itertuples():
                latest = max(latest, int(row.at_ms))
                if self.chunks.containsKey((int(row.seq),)):  # delivered again
                    continue
                size, n = size + len(row.chunk), n + 1
                last = int(row.seq) if row.is_last else last
                if size > self.max_size:
                    self.chunks.clear()
                    self.progress.update((-1, last, n))
                    self._restart_timer(latest)
                    yield self._result(key, None, size, "file_too_large")
                    size = -1
                    break
                self.chunks.updateValue((int(row.seq),), (bytes(row.chunk),))
        if size < 0:
            return
        if last >= 0 and n == last + 1:
            parts = sorted((k[0], v[0]) for k, v in self.chunks.iterator())
            self.chunks.clear()
            self.progress.clear()
            self._stop_timers()
            yield self._result(key, b"".join(bytes(p[1]) for p in parts), size, None)
            return
        self._restart_timer(latest)
        self.progress.update((size, last, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size = self.progress.get()[0] if self.progress.exists() else 0
        self.chunks.clear()
        self.progress.clear()
        # a rejected upload is only forgotten
        if size >= 0:
            yield self._result(key, None, size, "upload_timeout")

    def close(self) -> None:
        pass


def assemble_stream(
    chunks: DataFrame, max_size: int = rules.MAX_FILE_BYTES, timeout_s: int = 30, lateness: str = "30 seconds"
) -> DataFrame:
    """``(request_id, seq, chunk, is_last, ts)`` as they arrive → whole files and rejections."""
    out = (
        T.StructType().add("request_id", "string").add("content", "binary").add("size", "long").add("reject_reason", "string")
    )
    rows = chunks.withWatermark("ts", lateness).withColumn("at_ms", F.unix_millis("ts"))
    return _run(rows, "request_id", ChunkAssembly(max_size, timeout_s * 1000), out)


class Expiry(StatefulProcessor):
    """Announces the downloads of one shard when they are stored and again when their time is over."""

    def __init__(self, max_age_s: int) -> None:
        self.max_age_ms = max_age_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getListState("stored", "due long, id long, size long")
        self.timer = handle.getValueState("timer", _LONG)

    def _wake(self, due: int) -> None:
        self.handle.registerTimer(due)
        self.timer.update((due,))

    @staticmethod
    def _told(rows: list[tuple], event: str) -> pd.DataFrame:
        return pd.DataFrame({"id": [r[1] for r in rows], "size": pd.array([r[2] for r in rows], "Int64"), "event": event})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            new = [(at + self.max_age_ms, i, None if size is None else int(size))
                   for at, i, size in zip(batch["at_ms"].tolist(), batch["id"].tolist(), batch["digits"].tolist())]
            self.stored.appendList(new)
            first = min(r[0] for r in new) if first is None else min(first, min(r[0] for r in new))
            yield self._told(new, "stored")
        set_to = self.timer.get()[0] if self.timer.exists() else None
        if first is not None and (set_to is None or first < set_to):
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        over, later = [], []
        for row in self.stored.get():
            (over if row[0] <= watermark else later).append(tuple(row))
        if later:
            self.stored.put(later)
            self._wake(min(row[0] for row in later))
        else:
            self.stored.clear()
            self.timer.clear()
        if over:
            yield self._told(over, "expired")

    def close(self) -> None:
        pass


def download_expiry_stream(
    downloads: DataFrame, max_age_s: int = rules.DOWNLOAD_MAX_AGE_S, lateness: str = "1 minute", shards: int = 64
) -> DataFrame:
    """``(id, created_at, size)`` → ``stored`` rows, and ``expired`` rows once the watermark passes their age. Downloads are dealt to
    shards, as each of its own would cost several calls to the state store and a timer."""
    out = T.StructType().add("id", "long").add("size", "long").add("event", "string")
    # sizes go as text, as a null among numbers would turn them all into floats
    rows = downloads.withWatermark("created_at", lateness).withColumns({
        "at_ms": F.unix_millis("created_at"), "digits": F.col("size").cast("string"), "shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")})
    return _run(rows, "shard", Expiry(max_age_s), out)
