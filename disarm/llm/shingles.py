"""Word shingles of a column of texts as 64-bit hashes, computed on whole Arrow buffers at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(20240131)  # fixed: all tasks must hash alike
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = (_RNG.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1))[_LOWER]
_BYTE[_SPACE] = 0
_STEP = _U(0x9E3779B97F4A7C15)
#: Bytes of text hashed at a time; bounds the memory of the working arrays, whatever the length of a text.
PIECE = 2 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0x9FB21C651E98DF25)
    return h ^ (h >> _U(32))


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, _STEP, _U)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


_POWERS = _powers(4096)
_LENGTHS = _RNG.integers(1, 2**63, 64, dtype=_U)  # tell short texts of different lengths apart; shingles of up to 64 words


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that end at ``ends`` in ``data``, and how many words end by each end."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    first[edges] = ~space[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, _U), np.zeros(len(ends), np.int64)
    sizes = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
    longest = int(sizes.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    weighted = _BYTE[data[starts[0]:]] * powers[place]
    return _mix(np.add.reduceat(weighted, starts - starts[0])), np.searchsorted(starts, ends)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without white space, A-Z lower-cased), and each text's range in them.

    Null texts have no words. The second array has one entry more than there are texts.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    found, counts, at, row = [], np.zeros(len(texts) + 1, np.int64), int(bounds[0]), 0
    while at < bounds[-1]:
        stop = min(at + PIECE, int(bounds[-1]))
        last = int(np.searchsorted(bounds, stop, "right")) - 1  # texts that end within the piece
        if last > row:
            stop = int(bounds[last])
        elif stop < bounds[row + 1]:  # one long text: cut it between words
            gaps = np.flatnonzero(_SPACE[data[at:stop]])
            while not len(gaps) and stop < bounds[row + 1]:
                stop = min(stop + PIECE, int(bounds[row + 1]))
                gaps = np.flatnonzero(_SPACE[data[at:stop]])
            if stop < bounds[row + 1]:
                stop = at + int(gaps[-1]) + 1
        last = int(np.searchsorted(bounds, stop, "right")) - 1
        ends = np.append(bounds[row + 1:last + 1], stop) if last <= row or bounds[last] < stop else bounds[row + 1:last + 1]
        hashes, upto = _words(data[at:stop], ends - at)
        counts[row + 1:row + 1 + len(ends)] += np.diff(np.append(0, upto))
        found.append(hashes)
        at, row = stop, last
    return (np.concatenate(found) if found else np.empty(0, _U)), np.cumsum(counts)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; fewer words than ``words`` make one shingle, none an empty set."""
    hashes, bounds = word_hashes(texts)
    weights = _powers(words + 2)[1:-1] | _U(1)
    rolled = np.zeros(max(0, len(hashes) - words + 1), _U)
    for k in range(words if len(rolled) else 0):
        rolled += hashes[k:len(hashes) - words + 1 + k] * weights[k]
    rolled = _mix(rolled)
    sets = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if z - a >= words:
            sets.append(np.unique(rolled[a:z - words + 1]))
        elif z > a:
            parts = np.append(hashes[a:z] * weights[:z - a], _LENGTHS[z - a])
            sets.append(_mix(np.sum(parts, dtype=_U, keepdims=True)))
        else:
            sets.append(np.empty(0, _U))
    return sets
