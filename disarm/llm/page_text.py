"""Main text of web pages: wrapper induction over the pages of each host, then the article's slots.

The trees of a host's pages are aligned (``wrappers``): what stays the same from page to page is template, what varies
are slots. Names and roles of elements tell which varying slots aren't the article (menus that change, comments, adverts).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disarm.llm.html_tree import BOILERPLATE, TEXT, Node, parse
from disarm.llm.url_filter import url_host
from disarm.llm.wrappers import _size, align, dump, fold, load, matched, merge, varies
from disarm.staging import stage

#: element names and roles that aren't the article; a header inside it is
REGIONS = frozenset("nav aside footer form fieldset dialog menu".split())
ROLES = frozenset("navigation complementary contentinfo search alert alertdialog dialog menu menubar toolbar tablist".split())
OUTSIDE = frozenset("header masthead topbar copyright legal colophon".split())
_REMARKS = frozenset("comment comments reply replies".split())
_HELD_NODES = 100_000  # of wrappers in a task before they are handed on
BROADCAST_BYTES = 16 << 20  # wrappers of up to this size go to all tasks; more are joined by host


def _measure(node: Node) -> None:
    """Characters, characters in links, and how many articles and the like there are, of each node."""
    node.chars = sum(len(t) for t, _, _ in node.blocks)
    node.linked = sum(linked for _, linked, heading in node.blocks if not heading)
    for kid in node.kids:
        _measure(kid)
        node.chars += kid.chars
        node.linked += kid.linked
        node.holds.update(kid.holds)
    if node.tag == "main" or node.role == "main":
        node.holds["main"] += 1
    if node.tag == "article" and node.words.isdisjoint(_REMARKS):
        node.holds["article"] += 1
        node.holds["chars"] = node.chars
    node.holds["h1"] += any(heading for _, _, heading in node.blocks)


def _apart(node: Node, page: Node, inside: bool) -> bool:
    """Whether a region isn't the article by its name, its role or its links."""
    holds = node.holds
    if holds["main"] or holds["article"] and holds["article"] == page.holds["article"] and 2 * holds["chars"] > page.chars:
        return False  # all there is lies in it, whatever it is called; an end tag may be missing
    if node.tag == "article":
        return not node.words.isdisjoint(_REMARKS)
    if node.tag == "form" and holds["h1"] and not inside:
        return False  # a form around the whole page
    if node.tag in REGIONS or node.role in ROLES or node.hidden or not node.words.isdisjoint(BOILERPLATE):
        return True
    if inside:
        return False
    if node.tag == "header" or node.role == "banner" or not node.words.isdisjoint(OUTSIDE):
        return True
    return 2 * node.linked > node.chars


def _roots(page: Node) -> list[Node]:
    """The main elements or else the articles, where there are any that are not set apart."""
    for wanted in ("main", "article"):
        found, todo = [], [page]
        while todo:
            node = todo.pop()
            is_it = node.tag == wanted or node.role == wanted
            if node is not page and _apart(node, page, False) and not (is_it and node.words.isdisjoint(_REMARKS) and 2 * node.linked <= node.chars):
                continue
            if is_it:
                found.append(node)
            else:
                todo += reversed(node.kids)
        if found:
            return found
    return []


def _constant(node: Node, pages: int) -> int:
    """How many different pages show that the region stays the same; 0 if it doesn't, or is on less than half of them."""
    found = matched(node)

    def seen(w: Node) -> int:
        if 2 * w.n < pages or len(w.pages) < 2:
            return 0
        if w.label == TEXT:
            return 0 if w.digest is None else len(w.pages)
        return min((s for s in map(seen, w.kids)), default=0)

    return seen(found) if found is not None and found.n else 0


def main_blocks(html: str, wrapper: Node | None) -> list[str]:
    """The text blocks of a page's article, in page order."""
    page = parse(html)
    _measure(page)
    pages = 0
    if wrapper is not None and wrapper.n > 1 and varies(wrapper):
        align(wrapper, fold(page))
        pages = wrapper.n
    roots = _roots(page)
    kept: list[tuple[Node, int]] = []  # runs of text, and for how many different pages they are template

    def walk(node: Node, inside: bool, template: int) -> None:
        for kid in node.kids:
            if kid.label == TEXT:
                here = template or (0 if inside or not pages or 2 * kid.linked > kid.chars else _constant(kid, pages))
                if inside or 2 * kid.linked <= kid.chars:
                    kept.append((kid, here))
            elif not _apart(kid, page, inside):
                # an article's own elements are its text, however many pages repeat it; a bare division may be template
                judged = pages and (not inside or kid.tag == "div")
                walk(kid, inside, template or (_constant(kid, pages) if judged else 0))

    for root in roots or [page]:
        walk(root, bool(roots), 0)
    total = sum(run.chars for run, _ in kept)
    # pages that are copies of each other would make their article template: it can't be most of the text, unless
    # many different pages of a plain layout show it
    if 2 * sum(run.chars for run, seen in kept if seen) > total:
        enough = 99 if roots else 4
        kept = [(run, seen if seen >= enough else 0) for run, seen in kept]
    blocks = []
    for run, seen in kept:
        if seen:
            continue
        slot = matched(run) if pages else None
        texts = [t for t, _, _ in run.blocks]
        if slot is not None and slot.tail is not None and slot.digest is None and 2 * slot.n >= pages and len(slot.pages) > 1 and len(texts) > 1 and run.blocks[-1][2]:
            texts.pop()  # the heading of what follows, the same on all pages
        blocks += texts
    return blocks


def _decoded(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def induce_wrappers(pages: DataFrame, host: str = "_host", html: str = "_html") -> DataFrame:
    """(host, wrapper) for all hosts. Each task merges its pages of a host; the tasks' wrappers are merged in two rounds,
    in sorted order, so that a task holds one wrapper and one other at a time however many pages a host has."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, Node] = OrderedDict()
        nodes = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(parse(_decoded(text)))
                before = _size(held[name]) if name in held else 0
                held[name] = merge(held[name], folded) if name in held else folded
                nodes += _size(held[name]) - before
                if nodes > _HELD_NODES:
                    yield _batch(held)
                    held.clear()
                    nodes = 0
        if held:
            yield _batch(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, now = None, None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                other = load(text)
                if now is not None and key == name:
                    now = merge(now, other)
                    continue
                if now is not None:
                    yield _batch({name: now})
                name, now = key, other
        if now is not None:
            yield _batch({name: now})

    def _batch(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([dump(w) for w in found.values()])], ["host", "wrapper"])

    schema = "host string, wrapper string"
    parts = pages.select(host, F.col(html).cast("binary")).mapInArrow(partial, schema).withColumn("part", F.spark_partition_id())
    salted = parts.repartition("host", F.pmod("part", F.lit(64))).sortWithinPartitions("host", "part").drop("part")
    rounds = salted.mapInArrow(merged, schema).repartition("host").sortWithinPartitions("host", "wrapper")
    return rounds.mapInArrow(merged, schema)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text and n_chars (code points) of the article of every page; other columns are ignored.

    The host is what stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; urls without one
    (null too) make up a host of their own. A null or empty page, or one without an article, has an empty text. Blocks are
    joined by one line feed; white space inside one, line breaks included, is one space. Inside ``main`` or ``article``
    elements all text is kept but regions set apart by name or role, and divisions that are constant; elsewhere also what is mostly links, and
    runs of text that are constant, go. A host with one page, or whose pages are all the same, has no template. Repeated
    rows come out repeated; null ids are rows like any other.
    """
    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), url_host(F.col(url_col)).alias("_host"), F.col(html_col).cast("binary").alias("_html"))
    wrappers = stage(induce_wrappers(source), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    named = wrappers.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"))
    # beyond that size the join is by host, where Spark splits hosts with many pages (AQE's skew join)
    joined = source.join(F.broadcast(named) if size <= BROADCAST_BYTES else named.hint("merge"), "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, Node] = OrderedDict()
        for batch in batches:
            texts, lo, size = [], 0, 0
            for i in range(batch.num_rows):
                wrapper = batch.column(3)[i].as_py()
                if wrapper is not None and wrapper not in known:
                    if len(known) >= 64:
                        known.popitem(last=False)
                    known[wrapper] = load(wrapper)
                texts.append("\n".join(main_blocks(_decoded(batch.column(2)[i].as_py()), known.get(wrapper))))
                size += len(texts[-1])
                if size > 4 << 20 or i + 1 == batch.num_rows:
                    part = batch.slice(lo, i + 1 - lo)
                    made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names)
                    texts, lo, size = [], i + 1, 0

    names = [id_col, url_col, "text", "n_chars"]
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType), *T.StructType.fromDDL("text string, n_chars long")])
    return joined.select("_id", "_url", "_html", "_wrapper").mapInArrow(run, schema)
