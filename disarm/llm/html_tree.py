"""A lenient, linear reader of HTML: block elements as nodes, their text as blocks with white space collapsed."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

TEXT = "#text"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>]*)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values of HTML: element names by how they are read
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
MUTED = frozenset("noscript template svg canvas audio video object select button map datalist".split())
INLINE = frozenset("span ins small em strong b i u font label abbr mark sup sub time cite code".split())
NODES = frozenset("article main section div header footer nav aside form fieldset dialog menu ul ol dl table tr td th".split())
LEAVES = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd pre address hr figure figcaption blockquote summary details caption hgroup legend center "
    "thead tbody tfoot dir search listing".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: what a start tag closes first, and up to which open element
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    **{h: (HEADINGS, NODES) for h in HEADINGS},
}
_TABLE = frozenset("table td th caption".split())
_DEEPEST = 512  # elements open at once; deeper ones only break blocks
_NODES_DEEP = 60  # nodes above each other; text of deeper ones belongs to the last


class Node:
    """An element, or a run of text blocks (label ``#text``). ``into`` is what it was aligned with."""

    __slots__ = ("label", "tag", "words", "role", "hidden", "closed", "kids", "blocks", "depth", "digest", "tail", "n", "pages", "into", "chars", "linked", "holds")

    def __init__(self, label: str, tag: str = "", words: frozenset = frozenset(), role: str = "", hidden: bool = False, depth: int = 0) -> None:
        self.label, self.tag, self.words, self.role, self.hidden, self.depth = label, tag, words, role, hidden, depth
        self.kids: list[Node] = []
        self.blocks: list[tuple[str, int, bool]] = []  # text, characters in links, whether a heading
        self.closed, self.digest, self.tail, self.n, self.pages, self.into = False, None, None, 1, (), None
        self.chars = self.linked = 0
        self.holds = Counter()


def _node(tag: str, raw: str, depth: int) -> Node | None:
    """A node for elements that stand for a region of the page: containers, and whatever has a class, an id or a role."""
    named, role, hidden = [], "", False
    if raw.strip(" /\n\t\r"):
        for name, *values in _ATTRIBUTE.findall(raw):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                named.append(value)
            elif name == "role":
                role = value.strip().lower()
            elif name == "hidden" or re.search(r"display\s*:\s*none", value):
                hidden = True
    if tag not in NODES and not (named or role or hidden):
        return None
    # numbers in names tell pages apart, not regions
    words = frozenset(w.lower() for v in named for w in _WORD.findall(v))
    return Node(".".join([tag, *sorted(words)]), tag, words, role, hidden, depth)


def mutes(words) -> bool:
    """Whether an inline element of such names holds no text of the page's own."""
    return not words.isdisjoint(BOILERPLATE)


#: words in class names and ids of regions that are not the article's own, wherever they stand
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert alerts banner popup modal overlay newsletter subscribe subscription signup paywall sidebar aside nav navbar navigation menu menus "
    "submenu breadcrumb breadcrumbs pagination pager related recommended recommendations share sharing social comment comments respond disqus replies reply "
    "discussion footer login".split())


def parse(html: str) -> Node:
    """The tree of a page. Scripts, styles, controls and embedded objects leave nothing behind."""
    root = Node("#page")
    stack: list[tuple[str, Node]] = [("#page", root)]
    opened, beyond, endless = Counter(), Counter(), set()
    buffer: list[str] = []
    linked, link_at = 0, 0  # characters in links so far; open elements where the link began
    mute, mute_depth = "", 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                node = stack[-1][1]
                if not node.kids or node.kids[-1].label != TEXT:
                    node.kids.append(Node(TEXT, depth=node.depth + 1))
                node.kids[-1].blocks.append((text, min(linked, len(text)), stack[-1][0] in HEADINGS))
        linked = 0

    def pop_to(size: int) -> None:
        nonlocal link_at
        flush()
        while len(stack) > size:
            opened[stack.pop()[0]] -= 1
        if link_at > size:
            link_at = 0

    def close(names, until) -> None:
        """Close the nearest open element of these names, if no element of ``until`` is in between."""
        if any(opened[n] for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    return pop_to(i)
                if stack[i][0] in until:
                    return None
        return None

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not mute:
            piece = unescape(piece) if "&" in piece else piece
            buffer.append(piece)
            if link_at:
                linked += len(piece.strip())

    at = start = 0
    while (at := html.find("<", at)) >= 0:
        token = _TOKEN.match(html, at)
        if token is None:  # a sign like any other
            at += 1
            continue
        text(html[start:at])
        start = at = token.end()
        if token[2] is None:
            continue
        end, tag, attributes = token[1], token[2].lower(), token[3]
        if mute:
            mute_depth += (0 if tag != mute else -1 if end else 1)
            mute = mute if mute_depth else ""
        elif end:
            if tag == "a":
                link_at = 0
            elif beyond[tag]:
                beyond[tag] -= 1
                flush()
            elif tag in HEADINGS:
                close(HEADINGS, NODES)
            elif opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        stack[i][1].closed = True
                        pop_to(i)
                        break
                    if stack[i][0] in _TABLE and tag not in _TABLE and tag not in ("tr", "tbody", "thead", "tfoot"):
                        break
        elif tag in RAW:
            # text that is none, up to its end tag or else the end
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if found is None:
                break
            start = at = found.start()
        elif tag == "a":
            link_at = len(stack)
        elif tag == "br":
            text(" ")
        elif tag in NODES or tag in LEAVES:
            flush()
            close({"p"}, _TABLE)
            if tag in CLOSES:
                close(*CLOSES[tag])
            node = _node(tag, attributes, stack[-1][1].depth + 1)
            if tag == "hr":
                continue
            if len(stack) >= _DEEPEST:
                beyond[tag] += 1
                continue
            if node is not None and node.depth <= _NODES_DEEP:
                stack[-1][1].kids.append(node)
            else:
                node = stack[-1][1]
            stack.append((tag, node))
            opened[tag] += 1
        elif tag in MUTED or (tag in INLINE and "=" in attributes and (inline := _node(tag, attributes, 0)) is not None and mutes(inline.words)):
            if not attributes.endswith("/") and tag not in endless:
                if re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at) is None:
                    endless.add(tag)  # never closed: nothing is left out for it
                else:
                    mute, mute_depth = tag, 1
    else:
        text(html[start:])
    flush()
    return root
