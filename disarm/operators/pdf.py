"""PDF names that start active content: found by byte pattern, masked in place with equal length."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm import rules
from disarm.functions.content import latin1, latin1_bytes, pattern_hits
from disarm.operators.findings import finding

# the slash stands in front of the alternatives, so that other characters are passed by at one comparison each
_NAMES = "|".join(re.escape(name.removeprefix("/")) for name, *_ in rules.PDF_NAMES)
_AA = r"AA(?=[ \t\n\r<0-9])"
NAMES_REGEX = f"/(?:{_NAMES})"
AA_REGEX = f"/{_AA}"
ACTIVE_REGEX = f"/(?:{_NAMES}|{_AA})"
_LONGEST = max(len(name) for name, *_ in rules.PDF_NAMES)


def _mask(name: str) -> str:
    return "/" + "X" * (len(name) - 1)


def _by_name(hit: Column, field: int) -> Column:
    pairs = ", ".join(f"'{r[0]}', '{r[field]}'" for r in rules.PDF_NAMES)
    return F.expr(f"map({pairs})")[hit]


def name_hits(column: str) -> Column:
    """All hits in one scan: the named patterns, and ``/AA`` where it is a dictionary key."""
    return pattern_hits(column, ACTIVE_REGEX, _LONGEST, b"/")


def _is_aa(hit: Column) -> Column:
    return hit["hit"] == rules.PDF_AA[0]


def findings_of(hits: Column) -> Column:
    """All findings of one file: named patterns by offset, then additional-action keys by offset."""
    named = F.transform(
        F.filter(hits, lambda h: ~_is_aa(h)),
        lambda h: finding(
            _by_name(h["hit"], 1),
            F.concat(F.lit('byte pattern "'), h["hit"], F.lit('" at offset '), h["offset"].cast("string")),
            _by_name(h["hit"], 3),
            _by_name(h["hit"], 2),
        ),
    )
    _, kind, severity, text = rules.PDF_AA
    extra = F.transform(
        F.filter(hits, _is_aa),
        lambda h: finding(kind, F.concat(F.lit("byte offset "), h["offset"].cast("string")), text, severity),
    )
    return F.concat(named, extra)


def mask_spans(hits: Column) -> Column:
    """The masks of all hits, as spans for ``apply_spans``: each byte is copied once, however many names there are."""
    return F.transform(
        hits,
        lambda h: F.struct(
            h["offset"].alias("start"), F.length(h["hit"]).cast("bigint").alias("len"),
            F.concat(F.lit("/"), F.repeat(F.lit("X"), F.length(h["hit"]) - 1)).cast("binary").alias("replacement"),
        ),
    )


def mask(content: Column) -> Column:
    """The same bytes with every dangerous name overwritten by a mask of equal length.

    Every name has its only slash first and no mask starts a name, so replacing one name after
    another gives what a single pass gives.
    """
    text = reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(_mask(r[0]))), rules.PDF_NAMES, latin1(content))
    return latin1_bytes(F.regexp_replace(text, AA_REGEX, _mask("/AA")))


def pdf_findings(files: DataFrame) -> DataFrame:
    """Rows ``(file_id, offset, hit, type, severity)`` for the named patterns."""
    hits = files.select("file_id", F.explode(pattern_hits("content", NAMES_REGEX, _LONGEST, b"/")).alias("h"))
    return hits.select(
        "file_id", "h.offset", "h.hit",
        _by_name(F.col("h.hit"), 1).alias("type"), _by_name(F.col("h.hit"), 2).alias("severity"),
    )


def pdf_aa_findings(files: DataFrame) -> DataFrame:
    """Rows ``(file_id, offset, type, severity)`` for additional-action keys."""
    hits = files.select("file_id", F.explode(pattern_hits("content", AA_REGEX, 4, b"/")).alias("h"))
    return hits.select(
        "file_id", "h.offset", F.lit(rules.PDF_AA[1]).alias("type"), F.lit(rules.PDF_AA[2]).alias("severity")
    )


def pdf_mask(files: DataFrame) -> DataFrame:
    """Mask the content; clean files skip it."""
    active = F.rlike(latin1(F.col("content")), F.lit(ACTIVE_REGEX))
    return files.withColumn("content", F.when(active, mask(F.col("content"))).otherwise(F.col("content")))


def error_of(content: Column) -> Column:
    """Why a file of type pdf cannot be inspected; null when it can."""
    size = F.octet_length(content)
    return (
        F.when(size > rules.MAX_FILE_BYTES, F.format_string("pdf: file exceeds maximum size (%d bytes)", size))
        .when(size == 0, "pdf: empty file")
        .when(~F.startswith(content, F.lit(bytearray(b"%PDF"))), "pdf: invalid file, missing %PDF header")
    )
