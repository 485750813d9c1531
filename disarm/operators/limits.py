"""Sliding-window limiter: an event is accepted while fewer than ``max_events`` accepted ones are in the window.

Rejected events are not recorded, so each decision depends on earlier decisions of the key: a chain. Keys of up to
``hot_rows`` rows are decided whole, in one pass over rows sorted by key and time that jumps from acceptance to acceptance by
binary search. If any key has more, the rows are cut into ranges of (key, time), so that such a key is spread over many. How
many follows the rows, not the limit from which a key counts as hot:

* For one event the state between ranges is a moment, the earliest one that is accepted again, and a range is a step
  function of it. A tree is built: four neighbours are put together, then four of those, and so on, each function cut off a window
  past its first row. Moments then go down the tree. So all functions of a level have at most a step for each row.
* For more events the state is the list of the last acceptances. All ranges run at once from what they know of
  the range before, and run again while that has changed. Two runs that come to the same state are the same from there on,
  so a change rarely gets past a range. Where acceptances don't meet (a window that has most rows of a range), the first
  ranges that are not settled run one after the other, two million rows in a job.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disarm import rules
from disarm.staging import RANGE_ROWS, clear_staged, mark, range_width, stage

HOT_ROWS = 2_000_000
_NEVER, _ALWAYS = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _same(a, b) -> bool:
    return a == b or (a is None and b is None)


def _accept(at: np.ndarray, taken: deque, window: int) -> np.ndarray:
    """Decisions on the next rows of a key; ``taken`` holds its last acceptances and is brought up to date."""
    accepted, row = np.zeros(len(at), bool), 0
    while row < len(at):
        if len(taken) == taken.maxlen:  # the place taken so many acceptances ago must have come free
            row = max(row, int(np.searchsorted(at, taken[0] + window)))
            if row == len(at):
                break
        accepted[row] = True
        taken.append(int(at[row]))
        row += 1
    return accepted


def _runs(batch: pd.DataFrame, by: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(values, from, to) of the rows that follow each other with the same values; nulls are equal."""
    change = np.zeros(len(batch), bool)
    for c in by:
        before = batch[c].shift()
        change |= (batch[c].ne(before) & ~(batch[c].isna() & before.isna())).to_numpy()
    change[:1] = True
    starts = np.flatnonzero(change)
    for lo, hi in zip(starts, [*starts[1:], len(batch)]):
        yield tuple(None if pd.isna(batch[c].iat[lo]) else batch[c].iat[lo] for c in by), lo, hi


def _decide(max_events: int, window: int, by: list[str], entries: dict[int, list[int]] | None = None):
    """Decisions over sorted rows. The first key of a range goes on from ``entries`` of that range."""
    entries = entries or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, part, taken = None, None, deque(maxlen=max_events)
        for batch in batches:
            at, accepted = batch["at"].to_numpy(), np.zeros(len(batch), bool)
            for here, lo, hi in _runs(batch, by):
                if group is None or not all(_same(a, b) for a, b in zip(here, group)):
                    first = len(by) > 1 and here[0] != part
                    taken = deque(entries.get(here[0], []) if first else [], maxlen=max_events)
                    group, part = here, here[0]
                accepted[lo:hi] = _accept(at[lo:hi], taken, window)
            yield pd.DataFrame({"event_id": batch["event_id"], "accepted": accepted})

    return run


def rate_limit_decisions(events: DataFrame, max_events: int, window_s: int = rules.LIMIT_WINDOW_S, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``events(event_id, ts, key)`` → ``(event_id, accepted)``. A null key is a key of its own."""
    window = window_s * 1_000_000
    rows = events.select("event_id", "key", F.unix_micros("ts").alias("at"))
    out = "event_id long, accepted boolean"
    most, total = (n or 0 for n in rows.groupBy("key").count().agg(F.max("count"), F.sum("count")).first())
    if most <= hot_rows:
        by_key = rows.repartition("key").sortWithinPartitions("key", "at", "event_id")
        return by_key.mapInPandas(_decide(max_events, window, ["key"]), out)
    width = max(range_width(rows, total), 2)
    ranges = stage(rows.repartitionByRange(width, "key", "at", "event_id").withColumn("part", F.spark_partition_id()), "limit-ranges", "part")
    since = mark()
    entries = (_entries_of_one if max_events == 1 else _entries_of_many)(ranges, max_events, window)
    clear_staged(ranges.sparkSession, since)
    return _sorted(ranges).mapInPandas(_decide(max_events, window, ["part", "key"], entries), out)


def _sorted(ranges: DataFrame) -> DataFrame:
    return ranges.repartition("part").sortWithinPartitions("part", "key", "at", "event_id")


def _links(ranges: DataFrame) -> dict[int, tuple[bool, bool, int]]:
    """Of each range whether its first key goes on from the range before, whether it has no other key, and its rows.

    One row for each range, that is for about two million rows, comes to the driver.
    """
    ends = ranges.groupBy("part").agg(
        F.min(F.struct("key", "at", "event_id")).alias("first"), F.max(F.struct("key", "at", "event_id")).alias("last"),
        F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before = [None, *ends]
    return {e.part: (b is not None and _same(b.last.key, e.first.key), _same(e.first.key, e.last.key), e.n) for b, e in zip(before, ends)}


# --- one event: ranges as step functions of the moment from which an event is accepted ---


def _squeezed(times: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps with the same exit as one."""
    last = np.append(exits[1:] != exits[:-1], True) if len(exits) else np.zeros(0, bool)
    return times[last], exits[last]


def _steps(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(times, exits): entered with a moment t, a range is left with the exit at the first time >= t, or t where there is none."""
    n = len(at)
    jump = np.searchsorted(at, at + window)
    jump = np.where(jump < n, jump, np.arange(n))  # from acceptance to acceptance; the last one leads to itself
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    # no earlier acceptance reaches further than a window past the range's first row
    upto = min(n, int(np.searchsorted(at, at[0] + window)) + 1)
    return _squeezed(at[:upto], at[jump[:upto]] + window)


def _apply(times: np.ndarray, exits: np.ndarray, moments: np.ndarray) -> np.ndarray:
    if not len(times):
        return moments
    at = np.searchsorted(times, moments)
    return np.where(at < len(times), exits[np.minimum(at, len(times) - 1)], moments)


def _compose(first: tuple, then: tuple) -> tuple[np.ndarray, np.ndarray]:
    (t1, e1), (t2, e2) = first, then
    rest = t2 > (t1[-1] if len(t1) else _ALWAYS)
    return _squeezed(np.concatenate([t1, t2[rest]]), np.concatenate([_apply(t2, e2, e1), e2[rest]]))


def _within(times: np.ndarray, exits: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps for moments up to ``reach``."""
    upto = int(np.searchsorted(times, reach)) + 1
    return times[:upto], exits[:upto]


# ``reach`` is a window past the first row: no moment that a function is entered with is later
_TABLE = "part int, times binary, exits binary, reach long"
_FAN = 4


def _read(times: bytes, exits: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(times, np.int64), np.frombuffer(exits, np.int64)


def _row(part: int, made: tuple[np.ndarray, np.ndarray], reach: int) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "times": [made[0].tobytes()], "exits": [made[1].tobytes()], "reach": [reach]})


def _entries_of_one(ranges: DataFrame, _: int, window: int) -> dict[int, list[int]]:
    links = _links(ranges)
    order = sorted(links)
    place = {part: i for i, part in enumerate(order)}
    goes_on = {p: i + 1 < len(order) and links[order[i + 1]][0] for p, i in place.items()}
    single = {p: links[p][1] for p in order}

    def tables(key, rows: pd.DataFrame) -> pd.DataFrame:
        part, constant = int(key[0]), np.array([_NEVER])
        if not goes_on[part]:
            return _row(place[part], (constant, np.array([_ALWAYS])), _NEVER)
        last = rows["key"].iat[-1]
        same = rows["key"].isna() if pd.isna(last) else rows["key"] == last
        at = rows.loc[same, "at"].to_numpy()
        made = _steps(at, window)
        if not single[part]:  # the last key begins here, whatever comes before
            return _row(place[part], (constant, _apply(*made, np.array([_ALWAYS]))), _NEVER)
        return _row(place[part], made, int(at[0]) + window)

    def composed(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        reach = int(rows["reach"].iat[0])
        made = None
        for times, exits in zip(rows["times"], rows["exits"]):
            made = _within(*(_read(times, exits) if made is None else _compose(made, _read(times, exits))), reach)
        return _row(int(key[0]), made, reach)

    def entered(known: dict[int, int]):
        def run(key, rows: pd.DataFrame) -> pd.DataFrame:
            rows, moments = rows.sort_values("part"), [known[int(key[0])]]
            for times, exits in zip(rows["times"].iloc[:-1], rows["exits"].iloc[:-1]):
                moments.append(int(_apply(*_read(times, exits), np.array([moments[-1]]))[0]))
            return pd.DataFrame({"part": rows["part"].to_numpy(), "moment": moments})

        return run

    # a range is about two million rows of three numbers
    leaves = ranges.groupBy("part").applyInPandas(lambda key, rows: tables(key, rows.sort_values(["key", "at", "event_id"], na_position="first")), _TABLE)
    levels, n, node = [stage(leaves, "limit-steps")], len(order), F.floor(F.col("part") / _FAN).cast("int").alias("node")
    # a window of very many rows makes long functions; those are not put together any more
    while n > 1 and levels[-1].agg(F.max(F.octet_length("times"))).first()[0] // 8 <= RANGE_ROWS:
        levels.append(stage(levels[-1].groupBy(node).applyInPandas(composed, _TABLE), "limit-steps"))
        n = -(-n // _FAN)
    top, entry = levels.pop(), {0: int(_ALWAYS)}
    for i in range(n - 1):
        step = F.udf(lambda t, e, m=entry[i]: int(_apply(*_read(t, e), np.array([m]))[0]), "long")
        entry[i + 1] = top.where(F.col("part") == i).select(step("times", "exits")).first()[0]
    while levels:
        found = levels.pop().groupBy(node).applyInPandas(entered(entry), "part int, moment long")
        entry = {r.part: r.moment for r in found.collect()}
    # a moment stands for the acceptance a window before it
    return {p: [entry[i] - window] for p, i in place.items() if links[p][0] and entry[i] != _ALWAYS}


# --- more events: runs of all ranges at once, again where the entry has changed, in the end one after the other ---


def _entries_of_many(ranges: DataFrame, max_events: int, window: int) -> dict[int, list[int]]:
    links = _links(ranges)
    order = sorted(links)
    before = dict(zip(order[1:], order))

    def exits(rows: DataFrame, entries: dict[int, list[int]], chained: bool = False) -> dict[int, list[int]]:
        """What ranges leave for the next one: the last acceptances of their last key that count then.

        ``chained``: all rows are in one task, and each range goes on from the one before.
        """
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, key, taken, end = None, None, None, None
            for batch in batches:
                at = batch["at"].to_numpy()
                for (p, k), lo, hi in _runs(batch, ["part", "key"]):
                    if p != part:
                        if part is not None:
                            yield left(part, taken, end)
                        if part is None or not chained:
                            taken = deque(entries.get(p, []), maxlen=max_events)
                    elif not _same(k, key):
                        taken = deque(maxlen=max_events)
                    part, key = p, k
                    _accept(at[lo:hi], taken, window)
                    end = int(at[hi - 1])
            if part is not None:
                yield left(part, taken, end)

        def left(part, taken, end) -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "taken": [[t for t in taken if t > end - window]]})

        return {r.part: list(r.taken) for r in rows.mapInPandas(run, "part int, taken array<long>").collect()}

    def some(parts: list[int]) -> DataFrame:
        return ranges.where(F.col("part").isin(parts))

    def of(part: int) -> list[int]:
        return left[before[part]] if part in before and links[part][0] else []

    entries, left, last = {p: [] for p in order}, exits(_sorted(ranges), {}), 2 * len(order)
    # with another key after it, a range's end doesn't depend on its entry
    while todo := [p for p in order if links[p][1] and of(p) != entries[p]]:
        if 2 * len(todo) <= last:
            entries |= {p: of(p) for p in todo}
            left |= exits(_sorted(some(todo)), entries)
        else:
            chain, n = [todo[0]], links[todo[0]][2]
            for p in order[order.index(todo[0]) + 1:]:
                n += links[p][2]
                if n > RANGE_ROWS or not (links[p][0] and links[p][1]):
                    break
                chain.append(p)
            entries[chain[0]] = of(chain[0])
            left |= exits(some(chain).coalesce(1).sortWithinPartitions("part", "key", "at"), entries, chained=True)
            entries |= {p: of(p) for p in chain[1:]}
        last = len(todo)
    return {p: of(p) for p in order if of(p)}
