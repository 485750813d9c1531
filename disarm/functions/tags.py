"""Walk the tags of a markup document once, leniently.

Only structure is read here: where each token lies, what it opens or closes, and which subtrees go for the
element names asked for. What is dangerous is decided by rules outside. The walk is linear: a search for
an end mark that is not there is made once, not once for each place where the mark is wanted.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

_TOKEN = {
    "kind": pa.string(), "element": pa.string(), "gap": pa.int64(), "start": pa.int64(), "length": pa.int64(),
    "opens": pa.bool_(), "cut": pa.bool_(), "gap_cut": pa.bool_(),
}
_ARROW = pa.struct([
    ("tokens", pa.list_(pa.struct(list(_TOKEN.items())))), ("n_tokens", pa.int64()), ("tail", pa.int64()), ("tail_cut", pa.bool_()), ("fault", pa.string())])
_DDL = (
    "tokens array<struct<kind:string,element:string,gap:bigint,start:bigint,length:bigint,opens:boolean,cut:boolean,gap_cut:boolean>>, "
    "n_tokens bigint, tail bigint, tail_cut boolean, fault string")
_NAME = re.compile(rb"</?([A-Za-z_][^\s/>]*)")
_TAG = re.compile(rb"""</?([A-Za-z_][^\s/>]*+)(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")  # all quotes closed
_SUBSET_END = re.compile(rb"\]\s*>")


class _Ends:
    """Searches for end marks; a mark that was not found is not looked for again."""

    def __init__(self, data: bytes) -> None:
        self._data, self._gone = data, set()

    def find(self, mark: bytes, at: int) -> int:
        """Position behind the mark, or -1."""
        if mark in self._gone:
            return -1
        found = self._data.find(mark, at)
        if found < 0:
            self._gone.add(mark)
            return -1
        return found + len(mark)

    def search(self, mark: re.Pattern, at: int) -> int:
        if mark in self._gone:
            return -1
        found = mark.search(self._data, at)
        if not found:
            self._gone.add(mark)
            return -1
        return found.end()


def _raw_end(name: bytes) -> re.Pattern:
    return re.compile(rb"</(?:[\w-]+:)?" + re.escape(name) + rb"\s*>", re.I)


def _walk(data: bytes, ends: _Ends):
    """Tokens as (kind, name, start, end), and faults as ("fault", why, start, start)."""
    at, quotes = 0, True
    while (start := data.find(b"<", at)) >= 0:
        end, kind, name, mark = -1, "", b"", data[start + 1:start + 2]
        if mark == b"!":
            if data.startswith(b"<!--", start):
                end, kind = ends.find(b"-->", start + 4), "comment"
            elif data.startswith(b"<![CDATA[", start):
                end, kind = ends.find(b"]]>", start + 9), "cdata"
            else:
                end, kind = ends.find(b">", start + 2), "directive"
                subset = data.find(b"[", start, end) if end > 0 and data[start + 2:start + 9].lower() == b"doctype" else -1
                if subset > 0 and (closed := ends.search(_SUBSET_END, subset)) > 0:
                    end = closed
        elif mark == b"?":
            end, kind = ends.find(b"?>", start + 2), "pi"
        elif named := (quotes and _TAG.match(data, start)) or _NAME.match(data, start):
            name, kind = named[1], "end" if mark == b"/" else "start"
            if named.re is _TAG:
                end = named.end()
            if end < 0:  # a quote that nothing closes; from here on quotes mean nothing
                if quotes:
                    quotes = False
                    yield "fault", "quote", start, start
                end = ends.find(b">", named.end())
            if end > 0 and kind == "start":
                local = name.rpartition(b":")[2].lower()
                if data[end - 2:end - 1] == b"/":
                    kind = "empty"
                elif local in (b"script", b"style") and (closed := ends.search(_raw_end(local), end)) > 0:
                    kind, end = "raw", closed
        if end < 0:
            yield "fault", "stray", start, start
            at = start + 1
        else:
            yield kind, name, start, end
            at = end


class _Columns:
    """Tokens of many documents, by column: some forty bytes a token, where an object for each would take hundreds."""

    def __init__(self) -> None:
        self.ends, self.numbers, self.flags = array("i", [0]), [array("q") for _ in range(3)], [bytearray() for _ in range(3)]
        self.codes, self.names = [array("i") for _ in range(2)], {}
        self.missing, self.docs = bytearray(), []
        self._append = [column.append for column in (*self.codes, *self.numbers, *self.flags)]

    def token(self, kind: str, element: str | None, gap: int, start: int, length: int, opens: bool, cut: bool, gap_cut: bool) -> None:
        names, append = self.names, self._append
        append[0](names.setdefault(kind, len(names)))
        append[1](names.setdefault(element, len(names)))
        append[2](gap)
        append[3](start)
        append[4](length)
        append[5](opens)
        append[6](cut)
        append[7](gap_cut)

    def undo(self) -> None:
        """Forget the tokens of the document at hand."""
        n = self.ends[-1]
        for column in (*self.codes, *self.numbers, *self.flags):
            del column[n:]

    def close(self, doc: dict) -> None:
        self.missing.append(doc["n_tokens"] > doc.pop("limit"))
        self.ends.append(len(self.flags[0]))
        self.docs.append(doc)

    def arrow(self) -> pa.StructArray:
        names = pa.array(list(self.names), pa.string())
        words = [names.take(pa.array(np.frombuffer(c, np.int32))) for c in self.codes]
        longs = [pa.array(np.frombuffer(c, np.int64)) for c in self.numbers]
        bools = [pa.array(np.frombuffer(c, np.bool_)) for c in self.flags]
        tokens = pa.StructArray.from_arrays([*words, *longs, *bools], fields=list(_ARROW.field("tokens").type.value_type))
        lists = pa.ListArray.from_arrays(
            pa.array(np.frombuffer(self.ends, np.int32)), tokens, type=_ARROW.field("tokens").type,
            mask=pa.array(np.frombuffer(self.missing, np.bool_)) if self.docs else None)
        rest = [pa.array([d[f.name] for d in self.docs], f.type) for f in list(_ARROW)[1:]]
        return pa.StructArray.from_arrays([lists, *rest], fields=list(_ARROW))


def _read(data: bytes, cut: frozenset[str], void: frozenset[str], limit: int, into: _Columns) -> None:
    open_names: list[str] = []  # names of open elements, outermost first
    count: dict[str, int] = {}
    dropped_at = None  # height of the stack at the start of a subtree that goes
    before, n, fault = 0, 0, None
    for kind, name, start, end in _walk(data, _Ends(data)):
        if kind == "fault":
            fault = fault or name
            continue
        n += 1 + (start > before)
        if n > limit:
            into.undo()
            into.close({"limit": limit, "n_tokens": n, "tail": None, "tail_cut": None, "fault": fault})
            return
        element = name.rpartition(b":")[2].decode("latin-1") if name else None
        low = element.lower() if element else ""
        inside = dropped_at is not None
        gone, opens = inside, False
        if kind in ("start", "empty", "raw"):
            opens = not inside and low in cut
            gone = inside or opens
            if kind == "start" and low not in void:
                if opens:
                    dropped_at = len(open_names)
                open_names.append(low)
                count[low] = count.get(low, 0) + 1
        elif kind == "end":
            if count.get(low):
                while True:  # whatever is open inside ends with it
                    last = open_names.pop()
                    count[last] -= 1
                    if last == low:
                        break
                if inside and len(open_names) <= dropped_at:
                    gone = len(open_names) == dropped_at
                    dropped_at = None
            elif low in void:
                gone = inside or low in cut
            else:
                fault = fault or "end"
        into.token(kind, element, before, start, end - start, opens, gone, inside)
        before = end
    if open_names:
        fault = fault or "open"
    n += len(data) > before
    # the text behind the last token counts, but does not take the tokens away
    into.close({"limit": max(limit, n), "n_tokens": n, "tail": before, "tail_cut": dropped_at is not None, "fault": fault})


def tag_walk(cut: Sequence[str], void: Sequence[str], limit: int):
    """A column function of binary content: a struct of tokens, their number, the text behind them and the first fault.

    ``cut``: elements that go with all they hold; ``void``: elements without an end tag. A document of more
    than ``limit`` tokens has null tokens. Faults: stray, quote, end (of nothing), open (at the end).
    """
    cut_names, void_names = frozenset(cut), frozenset(void)

    @F.arrow_udf(_DDL)
    def walk(content: pa.Array) -> pa.Array:
        into = _Columns()
        for c in content:
            _read(c.as_py() or b"", cut_names, void_names, limit, into)
        return into.arrow()

    return walk
