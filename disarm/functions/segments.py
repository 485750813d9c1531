"""Length-chained image walks: each step depends on the last length, so they run as an Arrow function.

Only positions leave Python; all rules on the segments read the bytes on the JVM side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENTS = T.ArrayType(
    T.StructType().add("seg_idx", "integer").add("marker", "string").add("offset", "long").add("length", "long")
)
_ARROW = pa.list_(
    pa.struct([("seg_idx", pa.int32()), ("marker", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
)


def _jpeg_marker(code: int) -> str:
    if 0xE0 <= code <= 0xEF:
        return f"APP{code - 0xE0}"
    return "COM" if code == 0xFE else f"{code:02X}"


def _end_of_scan(data: bytes, at: int) -> int:
    """Position of the marker behind entropy-coded data; the length of the data without one."""
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        code = data[at + 1]
        if code == 0x00 or 0xD0 <= code <= 0xD7:
            at += 2
        elif code == 0xFF:
            at += 1
        else:
            return at
    return len(data)


def walk_jpeg(data: bytes):
    """Segments as ``(marker, offset, whole length)``; stops at anything malformed.

    Each scan, header and data, is one ``SOS`` segment (the last with the end marker), so what stands between the scans of a progressive
    image is seen too. Scans are told only if the image has an end; bytes behind it are one ``TRAILER``.
    """
    at, size, scans, behind = 2, len(data), False, []
    while at + 1 < size and data[at] == 0xFF:
        code = data[at + 1]
        if code == 0xD9 and scans:
            if behind[-1][0] == "SOS":  # the end marker goes with the last scan
                behind[-1] = ("SOS", behind[-1][1], at + 2 - behind[-1][1])
            yield from behind
            if at + 2 < size:
                yield "TRAILER", at + 2, size - at - 2
            return
        if 0xD0 <= code <= 0xD9:
            at += 2
            continue
        if at + 3 >= size:
            return
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        if length < 2 or at + 2 + length > size:
            return
        end = _end_of_scan(data, at + 2 + length) if code == 0xDA else at + 2 + length
        scans = scans or code == 0xDA
        segment = ("SOS" if code == 0xDA else _jpeg_marker(code), at, end - at)
        if scans:
            behind.append(segment)
        else:
            yield segment
        at = end


def walk_png(data: bytes):
    """Chunks after the signature: ``(chunk name, offset, whole length)``; stops at an overrun.

    Chunks past the end chunk are still listed; everything past it is one ``TRAILER`` as well.
    """
    at, size, image_end = 8, len(data), None
    while at + 8 <= size:
        whole = int.from_bytes(data[at : at + 4], "big") + 12
        if at + whole > size:
            break
        name = data[at + 4 : at + 8].decode("latin-1")
        yield name, at, whole
        at += whole
        if name == "IEND" and image_end is None:
            image_end = at
    if image_end is not None and image_end < size:
        yield "TRAILER", image_end, size - image_end


def _sub_blocks(data: bytes, at: int) -> int:
    """Position after a chain of length-prefixed blocks, or -1 when it runs out of data."""
    while at < len(data):
        if data[at] == 0:
            return at + 1
        at += data[at] + 1
    return -1


def walk_gif(data: bytes):
    """Blocks after the global colour table, up to the trailer byte."""
    if len(data) < 13:
        return
    at = 13 + (3 << ((data[10] & 7) + 1) if data[10] & 0x80 else 0)
    while at + 1 < len(data) and data[at] in (0x21, 0x2C):
        if data[at] == 0x21:
            name = {0xFE: "COMMENT", 0xFF: "APPLICATION"}.get(data[at + 1], "EXTENSION")
            end = _sub_blocks(data, at + 2)
        else:
            if at + 10 > len(data):
                return
            table = 3 << ((data[at + 9] & 7) + 1) if data[at + 9] & 0x80 else 0
            name, end = "IMAGE", _sub_blocks(data, at + 11 + table)
        if end < 0:
            return
        yield name, at, end - at
        at = end
    if at < len(data) and data[at] == 0x3B:
        yield "END", at, 1
        if at + 1 < len(data):
            yield "TRAILER", at + 1, len(data) - at - 1


_WALKS = {"jpeg": walk_jpeg, "png": walk_png, "gif": walk_gif}


@F.arrow_udf(SEGMENTS)
def image_segments(content: pa.Array, file_type: pa.Array) -> pa.Array:
    """Segments of a JPEG, PNG or GIF in file order; null for anything else."""
    rows = []
    for body, kind in zip(content, file_type):
        walk = _WALKS.get(kind.as_py())
        if walk is None or not body.is_valid:
            rows.append(None)
            continue
        rows.append(
            [
                {"seg_idx": i, "marker": marker, "offset": offset, "length": length}
                for i, (marker, offset, length) in enumerate(walk(body.as_py()))
            ]
        )
    return pa.array(rows, _ARROW)
