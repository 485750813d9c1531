"""Edit-aware token counts.

A document's text is cut into leaves at places where a pre-token always starts, whatever stands before: at a space
before a character that isn't white space, and between letters or digits and a sign that can't belong to them. A segment
tree over the leaves keeps characters and tokens. An edit finds its leaves by descending the tree, re-encodes only those
(and the one before, if the edit took away the place where its first leaf was cut), and updates the sums above them. The
text stays in its leaves until all edits are done, so an edit costs its region, not the document.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm.llm.tokens import added_tokens, encoded, tokenizer_path

LEAF = 512  # characters, about; a leaf ends at the next safe place
EDITS = "array<struct<start:int,removed:int,inserted:string>>"


@lru_cache(maxsize=2)
def _safe(path: str) -> re.Pattern:
    """Places where a leaf may start. White space before an added token belongs together, and no added token is cut."""
    added = added_tokens(path)
    signs = "".join(re.escape(c) for c in "@,;:/.!?()[]#=+*-<>|" if not any(c in t for t in added))
    ahead = "".join(f"(?!{re.escape(t)})" for t in added)
    return re.compile(rf"(?= \S)(?= {ahead})|(?<=[^\W_])(?=[{signs}])" if signs else rf"(?= \S)(?= {ahead})")


def _cut(text: str, path: str, size: int = LEAF) -> list[str]:
    """Leaves of a text, each but the first at a safe place."""
    leaves, at = [], 0
    while at < len(text):
        safe = _safe(path).search(text, at + size)
        stop = safe.start() if safe else len(text)
        leaves.append(text[at:stop])
        at = stop
    return leaves


class Tree:
    """Sums of characters and tokens over leaves; node 1 is the root, node k has 2k and 2k + 1."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1
        while self.width < len(chars):
            self.width *= 2
        pad = [0] * (self.width - len(chars))
        self.chars, self.tokens = [0] * self.width + chars + pad, [0] * self.width + tokens + pad
        for k in range(self.width - 1, 0, -1):
            self._add(k)

    @classmethod
    def stored(cls, chars: list[int], tokens: list[int]) -> Tree:
        """A tree as :meth:`lists` gave it; nothing is summed again."""
        tree = cls.__new__(cls)
        tree.width, tree.chars, tree.tokens = len(chars) // 2, list(chars), list(tokens)
        return tree

    def lists(self) -> tuple[list[int], list[int]]:
        return self.chars, self.tokens

    def _add(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character and where it starts; the last used leaf for a place behind the text."""
        k, start = 1, 0
        place = min(place, max(0, self.chars[1] - 1))
        while k < self.width:
            k *= 2
            if place >= start + self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def before(self, leaf: int) -> int | None:
        """The nearest leaf before that isn't empty."""
        while leaf > 0:
            leaf -= 1
            if self.chars[self.width + leaf]:
                return leaf
        return None

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.width + leaf
        self.chars[k], self.tokens[k] = chars, tokens
        while k > 1:
            k //= 2
            self._add(k)


def build(text: str, path: str) -> tuple[Tree, list[str]]:
    leaves = _cut(text, path) or [""]
    tree = Tree([len(x) for x in leaves], [len(encoded(x, path)) for x in leaves])
    return tree, leaves + [""] * (tree.width - len(leaves))


def leaves_of(text: str, tree: Tree) -> list[str]:
    """The text in the leaves of its tree."""
    made, at = [], 0
    for size in tree.chars[tree.width:]:
        made.append(text[at:at + size])
        at += size
    return made


def edit(leaves: list[str], tree: Tree, start: int, removed: int, inserted: str, path: str) -> int:
    """Make one edit in the leaves and bring the tree up to date; how many characters were encoded anew."""
    start = max(0, min(start, tree.chars[1]))
    removed = max(0, min(removed, tree.chars[1] - start))
    first, at = tree.leaf_at(start)
    last, _ = tree.leaf_at(start + removed)  # the leaf behind the edit is context too
    region = "".join(leaves[first:last + 1])
    region = region[:start - at] + inserted + region[start - at + removed:]
    while (before := tree.before(first)) is not None and not _safe(path).match(leaves[before][-1] + region, 1):
        region = leaves[before] + region  # the place of the cut is no longer safe
        first = before
    # the region is dealt to the places it has, so that leaves don't grow together
    slots = last + 1 - first
    pieces = _cut(region, path, max(LEAF, len(region) // slots))
    pieces[slots - 1:] = ["".join(pieces[slots - 1:])]
    for leaf, piece in enumerate(pieces + [""] * (slots - len(pieces)), first):
        if piece or leaves[leaf]:
            leaves[leaf] = piece
            tree.put(leaf, len(piece), len(encoded(piece, path)))
    return len(region)


def with_trees(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with a struct ``tree`` of two arrays, chars and tokens, the sums of all nodes. Null texts are empty."""
    path = path or tokenizer_path()

    @F.pandas_udf("chars array<int>, tokens array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([build(t or "", path)[0].lists() for t in texts], columns=["chars", "tokens"])

    return docs.withColumn("tree", run(F.col(text_col)))


def apply_edits(docs: DataFrame, text_col: str = "text", edits_col: str = "edits", path: str | None = None) -> DataFrame:
    """``docs`` with text, tree, n_tokens and encoded_chars after the edits of each row.

    Edits (EDITS) are applied in order, each to the text that the ones before left; places beyond the text are
    its end. Null edits or texts change nothing. Where leaves of more than
    sixteen times their size have been encoded for as long as the document is, it is cut anew. ``n_tokens`` equals a full encoding of the new text.
    """
    path = path or tokenizer_path()

    @F.pandas_udf("text string, chars array<int>, tokens array<int>, n_tokens int, encoded_chars long")
    def run(texts: pd.Series, trees: pd.DataFrame, edits: pd.Series) -> pd.DataFrame:
        made = []
        for text, chars, tokens, steps in zip(texts, trees["chars"], trees["tokens"], edits):
            text, tree, anew = text or "", Tree.stored(list(map(int, chars)), list(map(int, tokens))), 0
            leaves, grown = leaves_of(text, tree), 0
            for e in steps if steps is not None else ():
                n = edit(leaves, tree, e["start"], e["removed"], e["inserted"] or "", path)
                anew, grown = anew + n, grown + (n if n > 16 * LEAF else 0)
                if grown > max(16 * LEAF, 2 * tree.chars[1]):  # leaves have become large, at the cost of cutting anew
                    text = "".join(leaves)
                    (tree, leaves), anew, grown = build(text, path), anew + len(text), 0
            made.append(("".join(leaves), *tree.lists(), tree.tokens[1], anew))
        return pd.DataFrame(made, columns=["text", "chars", "tokens", "n_tokens", "encoded_chars"])

    changed = docs.withColumn("_after", run(F.col(text_col), F.col("tree"), F.col(edits_col)))
    return changed.withColumn(text_col, F.col("_after.text")).withColumn("tree", F.struct("_after.chars", "_after.tokens")).withColumn(
        "n_tokens", F.col("_after.n_tokens")).withColumn("encoded_chars", F.col("_after.encoded_chars")).drop("_after")


def redactions(text: Column, pattern: str, mark: str) -> Column:
    """Edits that put ``mark`` in place of every match of a pattern, from the last to the first."""

    @F.pandas_udf(EDITS)
    def run(texts: pd.Series) -> pd.Series:
        found = re.compile(pattern)
        return pd.Series([[(m.start(), m.end() - m.start(), mark) for m in found.finditer(t or "")][::-1] for t in texts])

    return run(text)
