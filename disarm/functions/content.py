"""Byte-level column functions. Content is read as ISO-8859-1, so one byte is one character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCAN_BLOCK = 2048


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def latin1_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def binary(value: bytes) -> Column:
    return F.lit(bytearray(value))


def uint_be(content: Column, offset: Column | int, width: int) -> Column:
    """Unsigned big-endian integer at a zero-based offset."""
    start = (offset if isinstance(offset, Column) else F.lit(offset)) + 1
    return F.conv(F.hex(F.substring(content, start, F.lit(width))), 16, 10).cast("bigint")


def uint_le(content: Column, offset: int, width: int) -> Column:
    """Unsigned little-endian integer at a zero-based offset."""
    digits = [F.hex(F.substring(content, offset + 1 + i, 1)) for i in reversed(range(width))]
    return F.conv(F.concat(*digits), 16, 10).cast("bigint")


def pattern_hits(column: str, regex: str, longest: int, lead: bytes = b"") -> Column:
    """Every match of ``regex`` in a binary column, with its byte offset: ``ARRAY<STRUCT<offset: BIGINT, hit: STRING>>``.

    The content is cut into short blocks that overlap by the longest match, so the work is linear
    in the content and every intermediate array is short. A match must never start inside another.
    If every match starts with ``lead``, blocks without it are passed by as bytes.
    """
    pattern = f"r'{regex}'"
    blocks = f"""
        transform(
          CASE WHEN octet_length({column}) > 0 THEN sequence(0L, octet_length({column}) - 1L, {SCAN_BLOCK}L) END,
          s -> struct(s AS at, substring({column}, int(s) + 1, {SCAN_BLOCK + longest + 1}) AS piece))"""
    led = f"""
        transform(filter({blocks}, b -> contains(b.piece, X'{lead.hex()}')),
          b -> struct(b.at AS at, decode(b.piece, 'ISO-8859-1') AS text))"""
    cut = f"""
        transform(filter({led}, b -> rlike(b.text, {pattern})),
          b -> struct(b.at AS at, regexp_extract_all(b.text, {pattern}, 0) AS hits, split(b.text, {pattern}, -1) AS gaps))"""
    # position of a hit in its block: the gaps up to it and the hits before it
    located = f"""
        flatten(transform({cut}, b -> filter(
          transform(b.hits, (h, i) -> struct(
            b.at + aggregate(slice(b.gaps, 1, i + 1), 0L, (acc, g) -> acc + length(g))
                 + aggregate(slice(b.hits, 1, i), 0L, (acc, g) -> acc + length(g)) AS offset,
            h AS hit)),
          x -> x.offset < b.at + {SCAN_BLOCK})))"""
    return F.expr(f"coalesce({located}, CAST(array() AS ARRAY<STRUCT<offset: BIGINT, hit: STRING>>))")


def apply_spans(content: Column, spans: Column) -> Column:
    """Replace byte spans. ``spans`` is sorted, disjoint ``ARRAY<STRUCT<start, len, replacement>>``.

    Each piece between two spans is cut out of the binary once, so the cost is linear.
    """
    count = F.size(spans)

    def end_of(i: Column) -> Column:
        return F.when(i == 0, F.lit(0).cast("bigint")).otherwise(
            F.get(spans, i - 1)["start"].cast("bigint") + F.get(spans, i - 1)["len"].cast("bigint")
        )

    def piece(start: Column, length: Column) -> Column:
        return latin1(F.substring(content, (start + 1).cast("int"), length.cast("int")))

    kept = F.transform(
        spans, lambda s, i: F.concat(piece(end_of(i), s["start"] - end_of(i)), latin1(s["replacement"]))
    )
    last = end_of(count)
    tail = piece(last, F.octet_length(content) - last)
    return F.when(count == 0, content).otherwise(latin1_bytes(F.concat(F.array_join(kept, ""), tail)))
