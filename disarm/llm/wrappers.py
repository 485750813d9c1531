"""Wrappers: trees that stand for all pages of a host, made by simple tree matching.

A page is folded first: a long run of neighbours of the same label becomes one node, so a list of any length is one. Then
pages are merged one by one, and partial wrappers with each other, by the alignment of their children that matches the most
nodes. A run of text keeps its digest as long as all its pages agree; where they don't, it is a varying slot.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from itertools import groupby

from disarm.llm.html_tree import TEXT, Node

LARGEST = 4096  # nodes in a wrapper before rare ones are forgotten; see prune
_PAIRS = 40_000  # children compared with children; beyond, they are aligned greedily by label
_RUN = 24  # neighbours of the same label that are still told apart
_WITNESSES = 4  # different pages remembered for a node


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "big")


def _weight(a: Node, b: Node, memo: dict) -> int:
    """Nodes that simple tree matching pairs; equal texts count double, so they are what holds an alignment."""
    if a.label != b.label:
        return 0
    if a.label == TEXT:
        return 2 if a.digest is not None and a.digest == b.digest else 1
    if not a.kids or not b.kids:
        return 1
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + sum(_weight(x, y, memo) for x, y in _pairs(a.kids, b.kids, memo))
    return memo[key]


def _pairs(left: list[Node], right: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """The ordered matching of children of the greatest weight."""
    if len(left) == len(right) and all(x.label == y.label for x, y in zip(left, right)):
        return list(zip(left, right))
    if len(left) * len(right) > _PAIRS:
        places: dict[str, list[int]] = {}
        for i, x in enumerate(left):
            places.setdefault(x.label, []).append(i)
        found, low = [], 0
        for y in right:
            at = places.get(y.label, [])
            k = bisect_left(at, low)
            if k < len(at):
                found.append((left[at[k]], y))
                low = at[k] + 1
        return found
    rows, columns = len(left), len(right)
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    for i in range(rows):
        for j in range(columns):
            w = _weight(left[i], right[j], memo)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
    found, i, j = [], rows, columns
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((left[i], right[j]))
    return found[::-1]


def _unite(a: Node, b: Node, memo: dict, same_page: bool) -> None:
    """Make ``a`` stand for ``b`` as well."""
    b.into = a
    if not same_page:
        a.n += b.n
        a.pages = tuple(sorted({*a.pages, *b.pages})[:_WITNESSES])
    if a.label == TEXT:
        a.digest = a.digest if a.digest == b.digest else None
        a.tail = a.tail if a.tail == b.tail else None
        return
    if not b.kids:
        return
    pairs = _pairs(a.kids, b.kids, memo)
    place = {id(x): i for i, x in enumerate(a.kids)}
    merged, done, taken = [], 0, {id(y): x for x, y in pairs}
    for y in b.kids:
        x = taken.get(id(y))
        if x is None:
            merged.append(y)  # new here: an optional node
            continue
        upto = place[id(x)] + 1
        merged += a.kids[done:upto]
        done = upto
        _unite(x, y, memo, same_page)
    a.kids = merged + a.kids[done:]


def fold(page: Node) -> Node:
    """Digest the texts of a page and make one node of each long run of neighbours with the same label; their ``into`` leads there.

    The page's nodes keep their children; what comes back are copies.
    """
    def copy(node: Node) -> Node:
        made = Node(node.label)
        if node.label == TEXT:
            made.digest = _digest("\n".join(b[0] for b in node.blocks))
            made.tail = _digest(node.blocks[-1][0]) if node.blocks[-1][2] else None
        made.pages = witness
        node.into = made
        for _, run in groupby(map(copy, node.kids), lambda k: k.label):
            alike = list(run)
            if len(alike) > _RUN:
                for other in alike[1:]:
                    _unite(alike[0], other, {}, True)
                del alike[1:]
            made.kids += alike
        return made

    def whole(node: Node) -> list[str]:
        return [b[0] for b in node.blocks] + [t for kid in node.kids for t in whole(kid)]

    witness = (_digest("\n".join(whole(page))),)
    return copy(page)


def merge(wrapper: Node, other: Node) -> Node:
    """A wrapper for the pages of both; ``other`` must not be used afterwards."""
    _unite(wrapper, other, {}, False)
    return prune(wrapper)


def _size(node: Node) -> int:
    return 1 + sum(map(_size, node.kids))


def prune(wrapper: Node) -> Node:
    """Forget rare nodes of a wrapper that has grown too large.

    Only nodes on half of the pages can become template, so those on less than an eighth (then a quarter, then a half) are
    no loss now. One that gets frequent later counts from then on, which can only keep text. What is left is in proportion to a page.
    """
    for share in (8, 4, 2):
        if _size(wrapper) <= LARGEST:
            break

        def keep(node: Node) -> None:
            node.kids = [k for k in node.kids if k.n * share >= wrapper.n]
            for k in node.kids:
                keep(k)

        keep(wrapper)
    return wrapper


def align(wrapper: Node, page: Node) -> None:
    """Point each node of a folded page to the wrapper's node that it matches; the wrapper stays as it is."""
    memo: dict = {}

    def pair(a: Node, b: Node) -> None:
        b.into = a
        for x, y in _pairs(a.kids, b.kids, memo):
            pair(x, y)

    pair(wrapper, page)


def matched(node: Node) -> Node | None:
    """The wrapper's node for a node of a page that was folded and aligned."""
    folded = node.into
    while folded is not None and folded.into is not None:
        folded = folded.into
    return folded


def dump(node: Node) -> str:
    def plain(x: Node) -> list:
        return [x.label, x.n, x.digest, x.tail, x.pages, [plain(k) for k in x.kids]]

    return json.dumps(plain(node), separators=(",", ":"))


def load(text: str) -> Node:
    def node(label, n, digest, tail, pages, kids) -> Node:
        made = Node(label)
        made.n, made.digest, made.tail, made.pages = n, digest, tail, tuple(pages)
        made.kids = [node(*k) for k in kids]
        return made

    return node(*json.loads(text))


def varies(node: Node) -> bool:
    """Whether any text below differs between pages."""
    return node.label == TEXT and node.digest is None or any(map(varies, node.kids))
