"""Image metadata: rules over segments, header dimensions, and removal of the flagged spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm import rules
from disarm.functions.content import apply_spans, binary, latin1, pattern_hits, uint_be, uint_le
from disarm.operators.findings import finding

GIF_EXTENSION_REGEX = r"!(?:\xFE|\xFF)"


def _text(number: Column) -> Column:
    return number.cast("string")


def jpeg_rule(marker: Column, payload: Column) -> Column:
    """Which rule a JPEG segment hits: ``exif_gps``, ``exif``, ``xmp``, ``app``, ``comment``, or null."""
    is_exif = (F.octet_length(payload) >= 6) & F.startswith(payload, binary(b"Exif"))
    has_gps = F.contains(payload, binary(b"\x88\x25")) | F.contains(payload, binary(b"\x25\x88"))
    is_xmp = (F.octet_length(payload) >= 29) & F.contains(payload, binary(rules.XMP_NAMESPACE.encode()))
    is_app = F.startswith(marker, F.lit("APP")) & ~marker.isin("APP0", "APP1")
    return (
        F.when((marker == "APP1") & is_exif, F.when(has_gps, "exif_gps").otherwise("exif"))
        .when((marker == "APP1") & is_xmp, "xmp")
        .when(is_app, "app")
        .when(marker == "COM", "comment")
    )


def jpeg_findings(marker: Column, rule: Column, offset: Column) -> Column:
    """Findings of one JPEG segment, as an array (EXIF with a position gives two)."""
    at = _text(offset)
    exif = finding(
        "exif", F.concat(F.lit("APP1 marker at offset "), at),
        "EXIF metadata stripped (may contain GPS, device info, timestamps)", "medium",
    )
    gps = finding("gps_location", F.concat(F.lit("EXIF GPS data at offset "), at), "GPS geolocation coordinates stripped", "high")
    xmp = finding(
        "xmp", F.concat(F.lit("APP1 XMP marker at offset "), at), "XMP metadata stripped (Adobe extensible metadata)", "low"
    )
    app = finding(
        "app_marker", F.concat(marker, F.lit(" marker at offset "), at),
        F.concat(marker, F.lit(" application marker stripped")), "low",
    )
    comment = finding("comment", F.concat(F.lit("COM marker at offset "), at), "JPEG comment stripped", "low")
    return (
        F.when(rule == "exif_gps", F.array(exif, gps))
        .when(rule == "exif", F.array(exif))
        .when(rule == "xmp", F.array(xmp))
        .when(rule == "app", F.array(app))
        .when(rule == "comment", F.array(comment))
    )


def png_finding(chunk: Column, offset: Column) -> Column:
    """Finding of one PNG chunk, or null."""

    def of(rule):
        name, kind, severity, text = rule
        return finding(kind, F.concat(F.lit(f"{name} chunk at offset "), _text(offset)), text, severity)

    first, *rest = rules.PNG_CHUNKS
    return reduce(lambda c, r: c.when(chunk == r[0], of(r)), rest, F.when(chunk == first[0], of(first)))


def gif_hits(column: str) -> Column:
    return pattern_hits(column, GIF_EXTENSION_REGEX, 2, b"!")


def gif_findings(content: Column, hits: Column) -> Column:
    """Comment and application extensions, found by their two lead bytes anywhere past the header."""
    size = F.octet_length(content)

    def one(h: Column) -> Column:
        at = _text(h["offset"])
        app = latin1(F.substring(content, (h["offset"] + 4).cast("int"), F.lit(8)))
        return F.when(
            F.endswith(h["hit"], F.lit("\xfe")),
            finding("comment", F.concat(F.lit("comment extension at offset "), at), "GIF comment extension stripped", "low"),
        ).when(
            h["offset"] + 14 < size,
            finding(
                "app_extension",
                F.concat(F.lit("application extension '"), app, F.lit("' at offset "), at),
                F.concat(F.lit("GIF application extension '"), app, F.lit("' stripped")), "low",
            ),
        )

    return F.array_compact(F.transform(F.filter(hits, lambda h: h["offset"] >= 13), one))


# --- operators on a table of segments ------------------------------------------------------------


def jpeg_segment_rules(segments: DataFrame) -> DataFrame:
    """``(file_id, seg_idx, marker, offset, payload)`` rows → one row per finding."""
    found = jpeg_findings(F.col("marker"), jpeg_rule(F.col("marker"), F.col("payload")), F.col("offset"))
    return segments.select("file_id", "seg_idx", F.explode(found).alias("f")).select("file_id", "seg_idx", "f.*")


def png_chunk_rules(segments: DataFrame) -> DataFrame:
    found = png_finding(F.col("marker"), F.col("offset"))
    return (
        segments.select("file_id", "seg_idx", found.alias("f")).where("f IS NOT NULL").select("file_id", "seg_idx", "f.*")
    )


def gif_extension_rules(files: DataFrame) -> DataFrame:
    """Whole GIF files → one row per extension found."""
    return files.select("file_id", F.posexplode(gif_findings(F.col("content"), gif_hits("content"))).alias("seq", "f")).select(
        "file_id", "seq", "f.*"
    )


# --- whole images --------------------------------------------------------------------------------


def dimensions(content: Column, file_type: Column, segments: Column) -> Column:
    """``STRUCT<width, height>`` from the header; null when the header is not there."""
    size = F.octet_length(content)

    def pair(width: Column, height: Column) -> Column:
        return F.struct(width.alias("width"), height.alias("height"))

    frame = F.get(F.filter(segments, lambda s: s["marker"].isin("C0", "C1", "C2")), F.lit(0))
    return (
        F.when(
            (file_type == "png") & (size >= 24) & (F.substring(content, 13, 4) == binary(b"IHDR")),
            pair(uint_be(content, 16, 4), uint_be(content, 20, 4)),
        )
        .when((file_type == "gif") & (size >= 13), pair(uint_le(content, 6, 2), uint_le(content, 8, 2)))
        .when(
            (file_type == "jpeg") & (frame["length"] >= 10),
            pair(uint_be(content, frame["offset"].cast("int") + 7, 2), uint_be(content, frame["offset"].cast("int") + 5, 2)),
        )
    )


def image_dimensions(files: DataFrame) -> DataFrame:
    """PNG and GIF header sizes, and whether the pixel cap is passed; JPEG needs its ``segments``."""
    segments = F.col("segments") if "segments" in files.columns else F.lit(None).cast(
        "array<struct<seg_idx: int, marker: string, offset: bigint, length: bigint>>"
    )
    size = dimensions(F.col("content"), F.col("original_type"), segments)
    return files.select("file_id", "original_type", size.alias("d")).select(
        "file_id", "original_type", "d.width", "d.height",
        (F.col("d.width") * F.col("d.height") > rules.MAX_PIXELS).alias("over_cap"),
    )


def _has(segments: Column, *markers: str) -> Column:
    return F.exists(segments, lambda s: s["marker"].isin(*markers))


def is_whole(file_type: Column, segments: Column) -> Column:
    """Structural check: the parts a decoder cannot do without are present."""
    return (
        F.when(file_type == "jpeg", _has(segments, "C0", "C1", "C2") & _has(segments, "SOS"))
        .when(file_type == "png", _has(segments, "IHDR") & _has(segments, "IDAT") & _has(segments, "IEND"))
        .otherwise(_has(segments, "IMAGE") & _has(segments, "END"))
    )


def with_rules(content: Column, file_type: Column, segments: Column) -> Column:
    """Segments with ``rule``: the JPEG rule hit, the name of a metadata chunk or block, or null."""

    def rule(s: Column) -> Column:
        payload = F.substring(content, (s["offset"] + 5).cast("int"), (s["length"] - 4).cast("int"))
        return (
            F.when(file_type == "jpeg", jpeg_rule(s["marker"], payload))
            .when((file_type == "png") & s["marker"].isin(*[c[0] for c in rules.PNG_CHUNKS]), s["marker"])
            .when((file_type == "gif") & s["marker"].isin("COMMENT", "APPLICATION"), s["marker"])
        )

    return F.transform(
        segments,
        lambda s: F.struct(s["marker"].alias("marker"), s["offset"].alias("offset"), s["length"].alias("length"), rule(s).alias("rule")),
    )


def segment_findings(content: Column, file_type: Column, ruled: Column, hits: Column) -> Column:
    """Findings of one image from its ruled segments; a GIF's come from the scan for lead bytes."""
    flagged = F.filter(ruled, lambda s: s["rule"].isNotNull())
    return (
        F.when(file_type == "jpeg", F.flatten(F.transform(flagged, lambda s: jpeg_findings(s["marker"], s["rule"], s["offset"]))))
        .when(file_type == "png", F.transform(flagged, lambda s: png_finding(s["marker"], s["offset"])))
        .otherwise(gif_findings(content, hits))
    )


def metadata_spans(ruled: Column) -> Column:
    """Byte spans to cut: flagged segments and whatever follows the end of the image."""
    trailer = F.get(F.filter(ruled, lambda s: s["marker"] == "TRAILER"), F.lit(0))["offset"]
    # only PNG chunks have such names; a small letter says that the image can be shown without the chunk
    unknown = lambda s: s["marker"].rlike("^[a-z][A-Za-z]{3}$") & ~s["marker"].isin(*rules.PNG_SHOWN)
    cut = F.filter(
        ruled,
        lambda s: (s["marker"] == "TRAILER") | ((s["rule"].isNotNull() | unknown(s)) & (trailer.isNull() | (s["offset"] < trailer))),
    )
    return F.transform(
        cut, lambda s: F.struct(s["offset"].alias("start"), s["length"].alias("len"), binary(b"").alias("replacement"))
    )


def strip_segments(content: Column, ruled: Column) -> Column:
    """The image without its metadata; pixels are left as they are."""
    return apply_spans(content, metadata_spans(ruled))
