"""SVG and HTML: the tags of a document are walked once, and everything else happens in the document's row.

The walk gives an array of tokens with their places and the subtrees that go. Rules are column expressions
over that array and the bytes it points to, so nothing is shuffled and no text is copied to find anything.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm import rules
from disarm.functions.content import latin1, latin1_bytes
from disarm.functions.tags import tag_walk
from disarm.operators.findings import finding, no_findings

# Forms inside a tag (fixed patterns). An attribute starts after white space, a slash or the end of a quoted value.
_ATTRS = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""
ATTRIBUTE_REGEX = rf"""(?s)(?:[\s/]+|(?<=["']))[^\s=/>"']+(?:\s*=\s*{_VALUE})?"""
_ATTRIBUTE_NAME = r"^[\s/]*([^\s=/]+)"
_NUMERIC_REF = r"(?i)&#(?:x[0-9a-f]+|[0-9]+);?"
_NAMED_REFS = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
MAX_CODE_DIGITS = 7  # of a code point without leading zeros; more cannot be ASCII


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it. Spark computes what is named twice inside
    a lambda twice, so that rules on rules on a value otherwise multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unescape(value: Column) -> Column:
    """The five XML entities and numeric references; code points past ASCII become ``?``."""
    hits = F.regexp_extract_all(value, F.lit(_NUMERIC_REF), F.lit(0))
    gaps = F.split(value, _NUMERIC_REF, -1)

    def decoded(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
        base = F.when(F.contains(F.lower(ref), F.lit("#x")), F.conv(digits, 16, 10)).otherwise(digits)
        code = F.when(digits == "", F.lit(0)).when(F.length(digits) <= MAX_CODE_DIGITS, base.cast("bigint"))
        return F.when(code < 128, F.char(code)).otherwise("?")

    plain = F.array_join(
        F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(decoded(F.get(hits, i)), F.lit("")))), ""
    )
    for ref, char in _NAMED_REFS:
        plain = F.replace(plain, F.lit(ref), F.lit(char))
    return F.when(F.contains(value, F.lit("&")), plain).otherwise(value)


def local_name(name: Column) -> Column:
    return F.substring_index(name, ":", -1)


def attribute_finding(element: Column, attr: Column, value: Column) -> Column:
    """Finding struct for one attribute (first rule that hits), or null. ``value`` is unescaped."""
    local = local_name(attr)
    low, full = F.lower(local), F.lower(attr)
    full = F.when(F.contains(full, F.lit("xlink")), F.concat(F.lit("xlink:"), low)).otherwise(low)
    where = F.concat(local, F.lit(" attribute on <"), element, F.lit(">"))
    trimmed = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    style = F.lower(value)
    return (
        F.when(
            F.startswith(low, F.lit("on")) & (F.length(low) > 2),
            finding("event_handler", where, F.concat(F.lit('Event handler attribute "'), local, F.lit('" stripped')), "high"),
        )
        .when(
            (full.isin(*rules.URI_ATTRIBUTES) | low.isin(*rules.URI_ATTRIBUTES))
            & F.startswith(trimmed, F.lit("javascript:")),
            finding(
                "javascript_uri", where, F.concat(F.lit("javascript: URI in "), local, F.lit(" attribute stripped")), "critical"
            ),
        )
        .when(
            (full.isin(*rules.LINK_ATTRIBUTES) | (low == "href"))
            & (F.startswith(trimmed, F.lit("http://")) | F.startswith(trimmed, F.lit("https://"))),
            finding("external_ref", where, F.concat(F.lit('External reference "'), value, F.lit('" stripped')), "medium"),
        )
        .when(
            (low == "style") & reduce(lambda a, b: a | b, [F.contains(style, F.lit(p)) for p in rules.STYLE_PATTERNS]),
            finding(
                "dangerous_css", F.concat(F.lit("style attribute on <"), element, F.lit(">")),
                "Dangerous CSS in inline style attribute stripped", "high",
            ),
        )
    )


def element_finding(element: Column) -> Column:
    """Finding struct for a dropped element, or null."""
    low = F.lower(element)

    def of(rule):
        name, kind, severity = rule
        return finding(
            kind, F.concat(F.lit("<"), element, F.lit("> element")),
            F.concat(F.lit("Dangerous <"), element, F.lit("> element stripped")), severity,
        )

    first, *rest = rules.MARKUP_ELEMENTS
    return reduce(lambda c, r: c.when(low == r[0], of(r)), rest, F.when(low == first[0], of(first)))


def css_findings(css: Column) -> Column:
    """One finding per dangerous pattern in a style element's text."""
    low = F.lower(css)
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.contains(low, F.lit(pattern)),
                    finding(kind, "<style> element", f'Dangerous CSS pattern "{pattern}" found in <style>', severity),
                )
                for pattern, kind, severity in rules.CSS_PATTERNS
            ]
        )
    )


# --- tokens --------------------------------------------------------------------------------------


def _void(html: bool) -> tuple[str, ...]:
    return rules.XML_VOID_ELEMENTS + (rules.HTML_VOID_ELEMENTS if html else ())


def walked(documents: DataFrame, html: bool = True) -> DataFrame:
    """``documents`` with ``walk``, a struct of the tokens; null tokens where there are too many or the file is too large."""
    walk = tag_walk([r[0] for r in rules.MARKUP_ELEMENTS], _void(html), rules.MAX_TOKENS)
    fits = F.octet_length("content") <= rules.MAX_FILE_BYTES
    return documents.withColumn("walk", walk(F.when(fits, F.col("content")))).withColumn(
        "walk", F.when(fits, F.col("walk")))


def _text(start: Column, length: Column) -> Column:
    return latin1(F.substring(F.col("content"), (start + 1).cast("int"), length.cast("int")))


def token_text(token: Column) -> Column:
    return _text(token["start"], token["length"])


def markup_tokens(documents: DataFrame, html: bool = True) -> DataFrame:
    """``(file_id, content)`` → one row per token: tok_idx, kind, element, start (in bytes), length, inside, dropped."""
    rows = walked(documents, html).select("file_id", F.posexplode("walk.tokens").alias("tok_idx", "t"))
    return rows.select(
        "file_id", "tok_idx", "t.kind", "t.element", "t.start", "t.length",
        (F.col("t.cut") & ~F.col("t.opens")).alias("inside"), F.col("t.opens").alias("dropped"))


def _pair_value(text: Column) -> Column:
    value = F.regexp_extract(text, r"(?s)^[\s/]*[^\s=/]+\s*=\s*(.*)$", 1)
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def attributes(token: Column) -> Column:
    """``ARRAY<STRUCT<attr, value>>`` of a start tag; the text of a raw element is not searched."""
    tag = F.regexp_extract(token, rf"(?s)^<[^\s/>]+({_ATTRS})>", 1)
    pairs = F.regexp_extract_all(tag, F.lit(ATTRIBUTE_REGEX), F.lit(0))
    return F.transform(
        pairs, lambda p: F.struct(F.regexp_extract(p, _ATTRIBUTE_NAME, 1).alias("attr"), once(_pair_value(p), _unescape).alias("value")))


def _style_text(token: Column) -> Column:
    body = F.regexp_extract(token, rf"(?is)^<{_ATTRS}>(.*)</[^<]*>$", 1)
    return _unescape(F.regexp_replace(body, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))


def _token_findings(token: Column) -> Column:
    """Findings of one token; nothing inside a dropped subtree is reported."""
    element = token["element"]

    def searched(text: Column) -> Column:
        by_attr = F.array_compact(F.transform(attributes(text), lambda a: attribute_finding(element, a["attr"], a["value"])))
        css = F.when((token["kind"] == "raw") & (F.lower(element) == "style"), once(_style_text(text), css_findings))
        plain = text.rlike(r"^<[^\s/>\"']*>$")  # no attributes; most tags
        return F.when(plain, no_findings()).otherwise(F.concat(by_attr, F.coalesce(css, no_findings())))

    return (
        F.when(token["opens"], F.array(element_finding(element)))
        .when(token["cut"] | ~token["kind"].isin("start", "empty", "raw"), no_findings())
        .otherwise(once(token_text(token), searched))
    )


def scanned(documents: DataFrame, html: bool = True) -> DataFrame:
    """:func:`walked` with ``each``, the findings of every token, and ``found``: (tok_idx, findings) of those that have any."""
    rows = walked(documents, html).withColumn("each", F.transform("walk.tokens", _token_findings))
    numbered = F.transform("each", lambda f, i: F.struct(i.alias("tok_idx"), f.alias("findings")))
    return rows.withColumn("found", F.filter(numbered, lambda x: F.size(x["findings"]) > 0))


def _cleaned_tag(token: Column, element: Column) -> Column:
    """A tag without its dangerous attributes (a javascript: URI is blanked instead); other text verbatim."""

    def kept(text: Column) -> Column:
        def by_rule(hit: Column) -> Column:
            return (
                F.when(hit.isNull(), text)
                .when(hit == "javascript_uri", F.concat(F.regexp_extract(text, r"(?s)^([\s/]*[^\s=/]+\s*=\s*)", 1), F.lit('""')))
                .otherwise("")
            )

        name, value = F.regexp_extract(text, _ATTRIBUTE_NAME, 1), once(_pair_value(text), _unescape)
        pair = F.struct(name.alias("attr"), value.alias("value"))
        return once(once(pair, lambda a: attribute_finding(element, a["attr"], a["value"]))["type"], by_rule)

    def of_head(token: Column, head: Column) -> Column:
        gaps = F.split(head, ATTRIBUTE_REGEX, -1)
        pairs = F.transform(F.regexp_extract_all(head, F.lit(ATTRIBUTE_REGEX), F.lit(0)), kept)
        new_head = F.array_join(F.zip_with(gaps, pairs, lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
        return F.concat(new_head, F.substring(token, F.length(head) + 1, F.length(token)))

    return once(token, lambda t: once(F.regexp_extract(t, rf"(?s)^<[^\s/>]+{_ATTRS}>", 0), lambda head: of_head(t, head)))


def _cleaned() -> Column:
    """The document's bytes without what is cut; untouched where there is nothing to cut."""

    def changed(t: Column, found: Column) -> Column:
        gap = F.when(t["gap_cut"], "").otherwise(_text(t["gap"], t["start"] - t["gap"]))
        bad_style = F.exists(found, lambda f: F.startswith(f["location"], F.lit("<style>")))
        token = F.when(t["cut"] | bad_style, "").when(F.size(found) > 0, _cleaned_tag(token_text(t), t["element"])).otherwise(token_text(t))
        return F.concat(gap, token)

    def piece(t: Column, i: Column) -> Column:
        found = F.get(F.col("each"), i)
        as_is = ~t["gap_cut"] & ~t["cut"] & (F.size(found) == 0)
        return F.when(as_is, _text(t["gap"], t["start"] + t["length"] - t["gap"])).otherwise(changed(t, found))

    tail = F.when(F.col("walk.tail_cut"), "").otherwise(_text(F.col("walk.tail"), F.octet_length("content")))
    joined = F.concat(F.array_join(F.transform("walk.tokens", piece), ""), tail)
    touched = (F.size("found") > 0) | F.exists("walk.tokens", lambda t: t["cut"])
    return F.when(touched, latin1_bytes(joined)).when(F.col("walk.tokens").isNotNull(), F.col("content"))


# --- operators -----------------------------------------------------------------------------------


def markup_findings(documents: DataFrame, html: bool = True) -> DataFrame:
    """One row per finding of a table of documents, with its token number."""
    found = scanned(documents, html).select("file_id", F.explode("found").alias("x"))
    return found.select("file_id", "x.tok_idx", F.explode("x.findings").alias("f")).select("file_id", "tok_idx", "f.*")


def attribute_rules(attrs: DataFrame) -> DataFrame:
    """``(file_id, tok_idx, element, attr, value)`` rows → one row per finding."""
    hit = attribute_finding(F.col("element"), F.col("attr"), F.col("value"))
    return (
        attrs.select("file_id", "tok_idx", "attr", hit.alias("f"))
        .where("f IS NOT NULL")
        .select("file_id", "tok_idx", "attr", "f.*")
    )


def strip_markup(documents: DataFrame, html: bool = True) -> DataFrame:
    """``(file_id, content, error_message)``: documents without dropped elements, attributes and styles.

    A document over the size or token limit has null content and the reason.
    """
    return scanned(documents, html).select("file_id", _cleaned().alias("content"), _over().alias("error_message"))


def _over() -> Column:
    return F.when(F.octet_length("content") > rules.MAX_FILE_BYTES, F.concat(
        F.lit("svg: file exceeds maximum size ("), F.octet_length("content").cast("string"), F.lit(" bytes)"))).when(
        F.col("walk.n_tokens") > rules.MAX_TOKENS,
        f"svg: exceeded maximum token count ({rules.MAX_TOKENS}), possible entity expansion attack")


def inspect_markup(documents: DataFrame) -> DataFrame:
    """SVG ``(file_id, content)`` → ``file_id, original_size, status, findings, error_message, output``.

    An end tag closes the nearest open element of its name and all within. A stray ``<``, an unclosed quote, an
    end tag of nothing and elements open at the end are parse errors; too many tokens block the file.
    """
    rows = scanned(documents, html=False)
    status = (
        F.when(F.octet_length("content") > rules.MAX_FILE_BYTES, "ERROR")
        .when(F.col("walk.n_tokens") > rules.MAX_TOKENS, "BLOCKED")
        .when(F.col("walk.fault").isNotNull(), "ERROR")
        .when(F.size("found") > 0, "SANITIZED")
        .otherwise("CLEAN")
    )
    fine = F.col("status").isin("SANITIZED", "CLEAN")
    return rows.withColumn("status", status).select(
        "file_id", F.octet_length("content").cast("bigint").alias("original_size"), "status",
        F.when(fine, F.flatten(F.transform("found", lambda x: x["findings"]))).otherwise(no_findings()).alias("findings"),
        F.when(~fine, F.coalesce(_over(), F.lit("svg: parsing XML: malformed document"))).alias("error_message"),
        F.when(fine, _cleaned()).alias("output"),
    )
