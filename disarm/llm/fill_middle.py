"""Fill-in-middle: texts cut in three at unit boundaries and put together in another order.

A unit is a run of letters A-Z, a-z or one other code point. Texts are never decoded to find units. The UTF-8
bytes of a batch are viewed as 64-bit words; arithmetic on whole words marks the byte that ends each unit, a
population count and a running sum over words tell how many units end before a word, a binary search finds the
word of the k-th unit, and the lanes of that one word are counted to find its byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_CHUNK = 4 << 20  # bytes of text whose words are held at once; a longer text is a chunk of its own

# the same byte in all eight lanes of a word
_LANES = np.uint64(0x0101010101010101)
_HIGH, _LOW7, _CASE = _LANES * np.uint64(0x80), _LANES * np.uint64(0x7F), _LANES * np.uint64(0x20)
_FROM_A, _PAST_Z = _LANES * np.uint64(0x80 - ord("a")), _LANES * np.uint64(0x80 - ord("z") - 1)
_ONE, _BYTE, _TOP = np.uint64(1), np.uint64(8), np.uint64(56)


def _next_lane(marks: np.ndarray) -> np.ndarray:
    """The mark of the byte after each byte; after the last one there is none."""
    after = marks >> _BYTE
    after[:-1] |= marks[1:] << _TOP
    return after


class Marks:
    """Byte marks over words, with their running count."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def before(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes stand before each byte position."""
        word, lane = at >> 3, (at & 7).astype(np.uint64)
        inside = np.minimum(word, len(self.words) - 1)
        below = self.words[inside] & ((_ONE << (lane * _BYTE)) - _ONE)
        return self.upto[word] + np.where(lane > 0, np.bitwise_count(below), 0)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position just after the k-th marked byte, counted from 1."""
        word = np.searchsorted(self.upto, k, side="left") - 1
        left = k - self.upto[word]
        lanes = (self.words[word][:, None] >> (np.arange(8, dtype=np.uint64) * _BYTE + np.uint64(7))) & _ONE
        return word * 8 + np.argmax(np.cumsum(lanes, axis=1) == left[:, None].astype(np.uint64), axis=1) + 1


def unit_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[Marks, Marks]:
    """Marks of the bytes that end a unit, and of those that begin a code point, in texts that lie one after the other."""
    padded = np.zeros(-(-len(data) // 8) * 8 + 8, np.uint8)
    padded[:len(data)] = data
    words = padded.view("<u8")
    folded = (words | _CASE) & _LOW7
    letters = (folded + _FROM_A) & ~(folded + _PAST_Z) & ~words & _HIGH
    inner = words & ~(words << _ONE) & _HIGH  # bytes 10xxxxxx
    ends = (letters & ~_next_lane(letters)) | (~letters & ~_next_lane(inner) & _HIGH)
    # a text's last byte ends its last unit whatever the next text begins with
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    lanes = ends.view(np.uint8)
    lanes[last] = 0x80
    starts = ~inner & _HIGH
    lanes[len(data):] = 0
    starts.view(np.uint8)[len(data):] = 0
    return Marks(ends), Marks(starts)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its texts begin and end; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data else np.zeros(0, np.uint8)), at - at[0]


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _CHUNK, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def _made(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, plain_from: int, suffix_first_below: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts that lie one after the other; ``draws`` has h1 to h4 by row."""
    ends, starts = unit_marks(data, offsets)
    before = ends.before(offsets[:-1])
    n = ends.before(offsets[1:]) - before
    first, second = np.sort(draws[:2] % (n + 1), axis=0)
    cut = [np.where(k > 0, ends.select(np.maximum(before + k, 1)) if len(data) else 0, offsets[:-1]) for k in (first, second)]
    sizes = [starts.before(b) - starts.before(a) for a, b in ((offsets[:-1], cut[0]), (cut[0], cut[1]))]
    raw = data.tobytes()
    p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
    forms, outputs = [], []
    for i, (lo, a, b, hi) in enumerate(zip(offsets[:-1].tolist(), cut[0].tolist(), cut[1].tolist(), offsets[1:].tolist())):
        if lo == hi or draws[2, i] % 100 >= plain_from or any(raw.find(mark, lo, hi) >= 0 for mark in (p, s, m)):
            forms.append("plain")
            outputs.append(raw[lo:hi])
        elif draws[3, i] % 100 < suffix_first_below:
            forms.append("spm")
            outputs.append(b"".join((s, raw[b:hi], p, raw[lo:a], m, raw[a:b])))
        else:
            forms.append("psm")
            outputs.append(b"".join((p, raw[lo:a], s, raw[b:hi], m, raw[a:b])))
    plain = np.array([f == "plain" for f in forms], bool)
    # the bytes of a string column are handed on as they are, valid UTF-8 or not
    joined = pa.array(outputs, pa.binary())
    text = pa.StringArray.from_buffers(len(joined), joined.buffers()[1], joined.buffers()[2])
    return [pa.array(n, pa.int64()), pa.array(forms), *(pa.array(c, pa.int64(), mask=plain) for c in sizes), text]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_from: int = 90, suffix_first_below: int = 20) -> DataFrame:
    """``id_col``, n, form (plain, psm or spm), prefix_chars, middle_chars and output of every whole text.

    The cuts and the form follow from the id alone: h1 to h4 are the first four 8-digit groups of the sha256 of
    ``1:`` and the decimal id (nothing for a null id). The prefix ends after the smaller of h1 % (n+1) and
    h2 % (n+1) units, the middle after the larger. Plain are empty texts, those that hold a mark already, and
    those with h3 % 100 >= ``plain_from``; of the others, h4 % 100 < ``suffix_first_below`` puts the suffix first. A null
    text is empty. Each row stands for itself, so repeated rows come out repeated; other columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch.column(1))
            drawn = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)])
            for lo, hi in _chunks(offsets):
                part = data[offsets[lo]:offsets[hi]]
                made = _made(part, offsets[lo:hi + 1] - offsets[lo], drawn[:, lo:hi], plain_from, suffix_first_below)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *made], [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL(
        "n long, form string, prefix_chars long, middle_chars long, output string")])
    return docs.select(id_col, text_col, *draws).mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text from its output and form alone. Each mark stands once in what is not plain, so it ends a part wherever it is."""
    def part(after: str, before: str) -> Column:
        rest = F.substr(output, F.instr(output, after) + len(after))
        return F.substring_index(rest, before, 1) if before else rest

    middle = part(MIDDLE, "")
    return (
        F.when(form == "psm", F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX)))
        .otherwise(output))
