"""Type detection: magic bytes first, the file extension only where they decide nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm import rules
from disarm.functions.content import binary, latin1
from disarm.functions.names import extension
from disarm.functions.zips import zip_listing


def _sniff(content: Column) -> Column:
    return F.lower(latin1(F.substring(content, 1, rules.SNIFF_BYTES)))


def is_pk(content: Column) -> Column:
    return F.startswith(content, binary(b"PK\x03\x04"))


def looks_like_markup(content: Column) -> Column:
    head = _sniff(content)
    return F.contains(head, F.lit("<svg")) | F.contains(head, F.lit("<?xml"))


def _magic_tests(content: Column) -> list[tuple[Column, str]]:
    """Leading bytes and the type they mean, in the order they are tried (fixed values)."""

    def starts(lead: bytes) -> Column:
        return F.startswith(content, binary(lead))

    return [
        (starts(b"%PDF"), "pdf"),
        (is_pk(content), "pk"),
        (starts(b"\xff\xd8\xff"), "jpeg"),
        (starts(b"\x89PNG\r\n\x1a\n"), "png"),
        (starts(b"GIF87a") | starts(b"GIF89a"), "gif"),
        (F.contains(_sniff(content), F.lit("<svg")), "svg"),
    ]


def magic_type(content: Column) -> Column:
    """Type by leading bytes; ``pk`` for any ZIP container, null when nothing matches."""
    (first, kind), *rest = _magic_tests(content)
    return reduce(lambda chain, t: chain.when(t[0], t[1]), rest, F.when(first, kind))


def extension_type(filename: Column) -> Column:
    pairs = ", ".join(f"'{ext}', '{kind}'" for ext, kind in rules.EXTENSION_TYPES.items())
    return F.coalesce(F.expr(f"map({pairs})")[extension(filename)], F.lit("unknown"))


def package_type(listing: Column) -> Column:
    """Office type by the first entry, in archive order, in one of the three part folders; else ``zip``."""
    kinds = F.transform(
        listing,
        lambda e: reduce(
            lambda chain, rule: chain.when(F.startswith(e["name"], F.lit(rule[0])), rule[1]),
            rules.OOXML_PREFIXES[1:],
            F.when(F.startswith(e["name"], F.lit(rules.OOXML_PREFIXES[0][0])), rules.OOXML_PREFIXES[0][1]),
        ),
    )
    return F.when(listing.isNotNull(), F.coalesce(F.get(F.array_compact(kinds), F.lit(0)), F.lit("zip")))


def may_be_container(content: Column, filename: Column) -> Column:
    """Files worth opening as a ZIP container: by magic, or by name where the bytes say nothing."""
    has_magic = reduce(lambda a, b: a | b, [test for test, _ in _magic_tests(content)])
    return is_pk(content) | (extension_type(filename).isin("zip", *rules.OFFICE_TYPES) & ~has_magic)


def with_listing(files: DataFrame) -> DataFrame:
    """Add ``listing``: the entry names of ZIP containers, null for everything else."""
    content = F.col("content")
    return files.withColumn("listing", zip_listing(F.when(may_be_container(content, F.col("filename")), content)))


def type_of(content: Column, filename: Column, listing: Column) -> Column:
    magic = magic_type(content)
    return F.coalesce(F.when(magic == "pk", package_type(listing)).otherwise(magic), extension_type(filename))


def detect_type(files: DataFrame) -> DataFrame:
    """Add ``original_type`` (and the container ``listing`` it may need) to a table of files."""
    return with_listing(files).withColumn(
        "original_type", type_of(F.col("content"), F.col("filename"), F.col("listing"))
    )


def is_supported(file_type: Column) -> Column:
    return file_type.isin(*rules.FILE_TYPES)
