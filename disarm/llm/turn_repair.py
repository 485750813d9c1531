"""Repair of conversations: a generalised LR parse of the roles in which rows may be deleted, reroled or inserted.

The role grammar is data; its LR tables are built once. Stacks share their tails, and for each row every stack
tries to keep it, rerole it or delete it, after inserting turns where that helps. Stacks that come out equal merge
by the least (cost, audit). Rows stream through in order: what all remaining stacks agree on is handed on at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = " \t\n\x0b\x0c\r"
#: ``(s?(ua)+)?`` over the initials of system, user and assistant
ROLE_GRAMMAR = (("C", ()), ("C", ("P",)), ("P", ("H", "u", "a")), ("P", ("P", "u", "a")), ("H", ()), ("H", ("s",)))


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # for each truncated row that stays
    #: roles that a row may be given and that may be inserted, by initial
    roles: tuple[tuple[str, str], ...] = field(default=(("u", "user"), ("a", "assistant")))
    #: no more turns than this are inserted at one place; two lead from any state of the role grammar to any other
    inserts: int = 2
    #: A stack this much dearer than the cheapest can't win. From any state of the role grammar, two inserts and one
    #: delete (of a system row) take the cheapest stack through the rest of the rows that the dearer one would accept.
    margin: int | None = 12


Stack = tuple  # (state, stack below); the empty one is (0, None)


class Parser:
    """LR(0) states with FOLLOW sets as lookahead; where tables conflict, a stack forks."""

    def __init__(self, grammar: Sequence[tuple[str, tuple[str, ...]]]) -> None:
        self.rules = [("^", (grammar[0][0],)), *grammar]
        self.names = {left for left, _ in self.rules}
        self.follow = self._follow()
        self.states: list[frozenset] = [self._closure({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for at, items in enumerate(self.states):  # grows while it is read
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                to = self._closure({(r, d + 1) for r, d in items if self.rules[r][1][d:d + 1] == (symbol,)})
                if to not in self.states:
                    self.states.append(to)
                self.goto[at, symbol] = self.states.index(to)
        self.made: dict[tuple[Stack, str], tuple[Stack, ...]] = {}

    def _closure(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            r, d = todo.pop()
            symbol = self.rules[r][1][d:d + 1]
            for k, (left, _) in enumerate(self.rules):
                if (left,) == symbol and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        empty, first, follow = set(), {n: set() for n in self.names}, {n: set() for n in self.names}
        follow["^"].add("$")

        def of(symbols) -> tuple[set[str], bool]:
            found = set()
            for s in symbols:
                found |= first.get(s, {s})
                if s not in empty:
                    return found, False
            return found, True

        def size() -> int:
            return len(empty) + sum(map(len, first.values())) + sum(map(len, follow.values()))

        before = -1
        while before != size():
            before = size()
            for left, right in self.rules:
                begins, vanishes = of(right)
                first[left] |= begins
                empty |= {left} if vanishes else set()
                for i, s in enumerate(right):
                    if s in self.names:
                        after, vanishes = of(right[i + 1:])
                        follow[s] |= after | (follow[left] if vanishes else set())
        return follow

    def _reduced(self, stack: Stack, ahead: str) -> list[Stack]:
        """The stack and all that reductions before ``ahead`` make of it."""
        found = [stack]
        for now in found:
            for r, d in self.states[now[0]]:
                left, right = self.rules[r]
                if r and d == len(right) and ahead in self.follow[left]:
                    below = now
                    for _ in right:
                        below = below[1]
                    to = (self.goto[below[0], left], below)
                    if to not in found:
                        found.append(to)
        return found

    def shift(self, stack: Stack, symbol: str) -> tuple[Stack, ...]:
        if (stack, symbol) not in self.made:
            made = [(self.goto[s[0], symbol], s) for s in self._reduced(stack, symbol) if (s[0], symbol) in self.goto]
            self.made[stack, symbol] = tuple(made)
        return self.made[stack, symbol]

    def accepts(self, stack: Stack) -> bool:
        return any((0, 1) in self.states[s[0]] for s in self._reduced(stack, "$"))


class Repair:
    """Moves of a stack by the kind of the next row, and what is inserted before an accepted end."""

    def __init__(self, grammar=ROLE_GRAMMAR, costs: Costs = Costs()) -> None:
        self.parser, self.costs = Parser(grammar), costs
        self.symbols = {s for _, right in grammar for s in right} - self.parser.names
        self.moves = lru_cache(maxsize=None)(self._moves)
        self.ends = lru_cache(maxsize=None)(self._ends)

    def _inserted(self, stack: Stack) -> Iterator[tuple[Stack, tuple[str, ...]]]:
        now = [(stack, ())]
        for _ in range(self.costs.inserts + 1):
            yield from now
            now = [(to, (*put, role)) for s, put in now for symbol, role in self.costs.roles for to in self.parser.shift(s, symbol)]

    def _moves(self, stack: Stack, initial: str, fault: str | None) -> tuple:
        """(next stack, cost, letters, roles inserted, role given or None to keep): an insert before a delete never wins."""
        costs = self.costs
        found = [(stack, costs.delete, "D", (), None)]
        if fault in ("blank", "duplicate"):
            return tuple(found)
        stays = costs.truncated if fault == "truncated" else 0
        for s, put in self._inserted(stack):
            price, letters = stays + costs.insert * len(put), "I" * len(put)
            if initial in self.symbols:
                found += [(to, price, letters + "K", put, None) for to in self.parser.shift(s, initial)]
            for symbol, role in costs.roles:
                if symbol != initial:
                    found += [(to, price + costs.rerole, letters + "R", put, role) for to in self.parser.shift(s, symbol)]
        return tuple(found)

    def _ends(self, stack: Stack) -> tuple | None:
        return next(((self.costs.insert * len(put), put) for s, put in self._inserted(stack) if self.parser.accepts(s)), None)


@lru_cache(maxsize=8)
def _repair(grammar, costs) -> Repair:
    return Repair(grammar, costs)


class Conversation:
    """The stacks of one conversation. A way taken is a chain of links [link before, row, move]; chains share their past.

    After each row all ways have as many row letters, so none is the start of another, and their order is a rank.
    """

    def __init__(self, repair: Repair) -> None:
        self.repair, self.margin = repair, repair.costs.margin
        self.start = [None, None, None]
        self.front: dict[Stack, tuple] = {(0, None): (0, 0, self.start)}  # stack: cost, rank, link
        self.held, self.look_at = 0, 256

    def add(self, row: tuple, initial: str, fault: str | None) -> list[tuple]:
        """Take the next row; edits that are certain by now come back."""
        best: dict[Stack, tuple] = {}
        for stack, (cost, rank, link) in self.front.items():
            for move in self.repair.moves(stack, initial, fault):
                offer = (cost + move[1], rank, move[2])
                if move[0] not in best or offer < best[move[0]][:3]:
                    best[move[0]] = (*offer, link, move)
        if self.margin is not None:
            limit = min(o[0] for o in best.values()) + self.margin
            best = {s: o for s, o in best.items() if o[0] <= limit}
        ordered = sorted(best.items(), key=lambda kv: kv[1][1:3])
        self.front = {s: (o[0], rank, [o[3], row, o[4]]) for rank, (s, o) in enumerate(ordered)}
        self.held += 1
        if self.held < self.look_at:
            return []
        return self._settled()

    def _settled(self) -> list[tuple]:
        ends = [link for _, _, link in self.front.values()]
        chain = []
        while any(e is not ends[0] for e in ends):  # all ways have equally many links
            ends = [e[0] for e in ends]
        link = ends[0]
        while link is not self.start and link is not None:
            chain.append(link)
            link = link[0]
        certain = _edits(reversed(chain))
        if chain:  # the last common link begins all chains from now on
            self.start = chain[0]
            self.start[:] = [None, None, None]
        self.held -= len(chain)
        self.look_at = max(256, 2 * self.held)
        return certain

    def finish(self) -> list[tuple]:
        done = []
        for stack, (cost, rank, link) in self.front.items():
            end = self.repair.ends(stack)
            if end is not None:
                done.append((cost + end[0], rank, "I" * len(end[1]), link, end[1]))
        _, _, _, link, put = min(done, key=lambda d: d[:3])
        chain = []
        while link is not self.start and link is not None:
            chain.append(link)
            link = link[0]
        return _edits(reversed(chain)) + [("I", role, None) for role in put]


def _edits(links) -> list[tuple]:
    """(letter, role given or None, row or None) of each step."""
    found = []
    for _, row, (_, _, letters, put, role) in links:
        found += [("I", r, None) for r in put]
        found.append((letters[-1], role, row))
    return found


def _key(column: str):
    return F.col(f"`{column}`")


def with_faults(turns: DataFrame) -> DataFrame:
    """``turns`` with ``copy``, which occurrence of its role and text in the conversation a row is, and ``fault``: blank, duplicate
    (role and text seen earlier), truncated, or null. Rows that are equal in all columns are told apart by ``copy`` alone."""
    said = F.rtrim("text", F.lit(SPACES))
    copies = W.partitionBy("conv_id", "role", "text").orderBy("turn")
    return turns.withColumn("copy", F.row_number().over(copies)).withColumn(
        "fault", F.when(said == "", "blank").when(F.col("copy") > 1, "duplicate")
        .when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated"))


#: texts travel as bytes, valid UTF-8 or not
EDITS = "seq long, edit string, turn long, role binary, text binary, fault string, repaired_role binary"
TEXTS = ("role", "text", "repaired_role")


def repair_turns(turns: DataFrame, grammar=ROLE_GRAMMAR, costs: Costs = Costs(), present: str | None = None) -> DataFrame:
    """The cheapest edits that make each conversation's roles follow the grammar, one row per edit, in order.

    ``turns(conv_id, turn, role, text)`` → conv_id, seq, edit (K, R, D or I: kept, reroled, deleted, inserted), turn,
    role, text and fault of the row, and repaired_role (null where deleted; inserted turns have an empty text and a
    null turn). Of equally cheap repairs the one whose letters come first in ASCII order is taken. Rows stand in the order
    of turn, role, text, nulls first; null roles and texts are empty; a null conv_id is a conversation of its own.
    A role counts by its first character. Rows for which the boolean column ``present`` is not true only say that
    the conversation exists: one without other rows gives a single row with a null edit. Other columns are ignored.

    One task takes a conversation's rows in order, from a sort that can spill. It holds a batch and those rows on which the
    stacks still differ: a few as a rule, but the whole conversation where its roles are all unknown to the grammar.
    """
    here = F.lit(True) if present is None else F.coalesce(_key(present), F.lit(False))
    empty = F.lit("")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), here.alias("present"))
    # absent rows make one group that says nothing
    rows = rows.select("conv_id", *[F.when(F.col("present"), F.col(c)).alias(c) for c in ("turn", "role", "text")], "present")
    # the window groups by more than conv_id, so the one exchange serves it and the order below
    judged = with_faults(rows.repartition("conv_id")).sortWithinPartitions("conv_id", "present", "turn", "role", "text", "copy")
    sent = judged.select("conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "fault", "present")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = _repair(grammar, costs)
        now, conversation, seq, out, size = None, None, 0, [], 0
        names = [f.name for f in schema.fields]

        def put(edits) -> None:
            nonlocal seq, size
            for letter, given, row in edits:
                if row is None:
                    out.append((now[0], seq, letter, None, None, b"", None, given.encode()))
                else:
                    turn, role, text, fault = row
                    kept = None if letter == "D" else given.encode() if given is not None else role
                    out.append((now[0], seq, letter, turn, role, text, fault, kept))
                    size += len(text)
                seq += 1

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            columns = list(zip(*out)) if out else [()] * len(names)
            out, size = [], 0
            arrays = [pa.array(columns[0], key_type)]
            for column, kind in zip(columns[1:], (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary())):
                arrays.append(pa.array(column, kind))
            return pa.RecordBatch.from_arrays(arrays, names)

        def close() -> None:
            if conversation is not None:
                put(conversation.finish())
            elif now is not None:
                out.append((now[0], None, None, None, None, None, None, None))

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, turn, role, text, fault, there in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != key:
                    close()
                    now, conversation, seq = (key,), None, 0
                if there:
                    conversation = conversation or Conversation(repair)
                    put(conversation.add((turn, role, text, fault), role[:1].decode("latin-1"), fault))
                if size > 4 << 20 or len(out) > 20_000:
                    yield flush()
        if key_type is not None:
            close()
            yield flush()

    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *T.StructType.fromDDL(EDITS)])
    return sent.mapInArrow(run, schema).withColumns({c: F.col(c).cast("string") for c in TEXTS})


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: initials that stand next to each other in the role grammar
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def conversation_report(edits: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation of :func:`repair_turns`, straight from its result, whose order is kept by narrow steps.

    gaps (missing turn numbers), numbers of blank, duplicate and truncated rows, illegal (pairs of adjacent roles that are
    not ``LEGAL``), cost, audit (the letters) and the digest of the repaired ``role:text``
    lines. Conversations without rows have zeros and empty values.
    """
    kind = edits.schema["conv_id"].dataType
    prices = {"K": 0, "R": costs.rerole, "D": costs.delete, "I": costs.insert}
    sent = edits.withColumns({c: F.col(c).cast("binary") for c in TEXTS})
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(REPORT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key_type = None, None

        def close() -> pa.RecordBatch:
            key, low, high, distinct, faults, illegal, cost, letters, digest = now[:9]
            gaps = high - low + 1 - distinct if low is not None else 0
            row = (key, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(letters), digest.hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([row[0]], key_type), *(pa.array([v]) for v in row[1:])], [f.name for f in schema.fields])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, seq, edit, turn, role, text, fault, given in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != key:
                    if now is not None:
                        yield close()
                    now = [key, None, None, 0, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, [], hashlib.sha256(), None, True]
                if edit is None:
                    continue
                now[6] += prices[edit] + (costs.truncated if fault == "truncated" and edit != "D" else 0)
                now[7].append(edit)
                if fault:
                    now[4][fault] += 1
                if edit != "I":
                    initial = role[:1].decode("latin-1")
                    now[5] += now[9] is not None and (now[9], initial) not in LEGAL
                    now[9] = initial
                    if turn is not None:
                        now[3] += turn != now[2]
                        now[1], now[2] = (turn if now[1] is None else now[1]), turn
                if edit != "D":
                    now[8].update((b"" if now[10] else b"\n") + given + b":" + text)
                    now[10] = False
        if now is not None:
            yield close()

    return sent.mapInArrow(run, schema)
