"""The ZIP container codec, as Arrow functions and a table function.

Only reading and writing of the container happens here; which entries are dangerous, kept or
replaced is decided by column expressions on the listing.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disarm.rules import MAX_ARCHIVE_BYTES, MAX_ARCHIVE_DEPTH, MAX_ENTRY_BYTES

_FLUSH = 8 << 20  # bytes of members held before they are handed on
_ROW = 512  # bytes that a member's row takes in Python besides its content

LISTING = T.ArrayType(
    T.StructType().add("entry_idx", "integer").add("name", "string").add("declared_size", "long")
)
_LISTING_ARROW = pa.list_(
    pa.struct([("entry_idx", pa.int32()), ("name", pa.string()), ("declared_size", pa.int64())])
)
ENTRY = T.StructType().add("entry_idx", "integer").add("size", "long").add("content", "binary").add("error", "string")
PARTS = T.ArrayType(ENTRY)
_PARTS_ARROW = pa.list_(
    pa.struct([("entry_idx", pa.int32()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
)


def _open(content: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except Exception:
        return None


def read_entries(content: bytes, wanted: list[int], with_content: set[int] | None):
    """Yield ``(entry_idx, size, content, error)`` for the wanted entries, in order.

    Every entry is read up to one byte over its cap, and reading stops once the total crosses the
    archive cap, so a bomb costs bounded work.
    """
    archive = _open(content)
    if archive is None:
        return
    infos, total = archive.infolist(), 0
    for idx in wanted:
        try:
            with archive.open(infos[idx]) as stream:
                body = stream.read(MAX_ENTRY_BYTES + 1)
        except Exception as exc:
            yield idx, None, None, f"{type(exc).__name__}: {exc}"
            continue
        size = len(body)
        if size <= MAX_ENTRY_BYTES:
            total += size
        keep = size <= MAX_ENTRY_BYTES and (with_content is None or idx in with_content)
        yield idx, size, body if keep else None, None
        if total > MAX_ARCHIVE_BYTES:
            return


def in_pieces(batches: Iterator, one: Callable, kind: pa.DataType, weight: Callable[..., int]) -> Iterator[pa.Array]:
    """``one`` of every row as arrays of some megabytes, whatever a batch comes to: its results are never held all at once."""
    for batch in batches:
        made, held = [], 0
        for row in zip(*(batch if isinstance(batch, tuple) else (batch,))):
            made.append(one(*row))
            held += _ROW + (0 if made[-1] is None else weight(made[-1]))
            if held > _FLUSH:
                yield pa.array(made, kind)
                made, held = [], 0
        if made:
            yield pa.array(made, kind)


@F.arrow_udf(LISTING)
def zip_listing(content: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Entry names and declared sizes in archive order; null when the container is unreadable."""

    def one(body):
        archive = _open(body.as_py()) if body.is_valid else None
        if archive is None:
            return None
        return [
            {
                "entry_idx": i,
                "name": info.orig_filename.encode("utf-8", "replace").decode("utf-8"),
                "declared_size": min(info.file_size, 2**63 - 1),
            }
            for i, info in enumerate(archive.infolist())
        ]

    yield from in_pieces(content, one, _LISTING_ARROW, lambda entries: _ROW * len(entries))


@F.arrow_udf(PARTS)
def zip_parts(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of content, wanted and with_content: sizes (and, where asked for, bytes) of the wanted entries of one container."""

    def one(body, wanted, with_content):
        if not body.is_valid:
            return None
        found = read_entries(body.as_py(), wanted.as_py() or [], set(with_content.as_py() or []))
        return [dict(zip(("entry_idx", "size", "content", "error"), part)) for part in found]

    yield from in_pieces(columns, one, _PARTS_ARROW, lambda parts: sum(_ROW + len(p["content"] or b"") for p in parts))


@F.udtf(returnType=ENTRY)
class ArchiveEntries:
    """Table function: one row per wanted entry (all entries when none are named)."""

    def eval(self, content: bytes, wanted: list):
        if content is None:
            return
        if wanted is None:
            archive = _open(content)
            if archive is None:
                yield None, None, None, "invalid archive"
                return
            wanted = range(len(archive.infolist()))
        yield from read_entries(content, wanted, None)


WALK = "path string, depth int, entry_idx int, size long, sha256 string, content binary, error string"


def walk_members(files: DataFrame, id_col: str = "file_id", content_col: str = "content", max_depth: int = MAX_ARCHIVE_DEPTH, with_content: bool = False) -> DataFrame:
    """All members of containers and of the containers inside them, in one pass: ``id_col`` and WALK.

    ``path`` joins member names by ``/`` from the outermost container on, ``depth`` counts from 0. A member that is a container
    itself has its own row before those of its members; below ``max_depth`` it isn't opened. Members over the entry cap have a size
    and no digest; the walk of a container ends at the member that takes its total over the archive cap; what can't be read has an
    error. A file that is no container gives one row with an error and no path, a null one none. One member, and the
    containers around it, are in memory at a time.
    """
    def walk(body: bytes, prefix: str, depth: int):
        archive = _open(body)
        if archive is None:
            return
        infos = archive.infolist()
        for idx, size, content, error in read_entries(body, list(range(len(infos))), None):
            path = prefix + infos[idx].orig_filename.encode("utf-8", "replace").decode("utf-8")
            digest = hashlib.sha256(content).hexdigest() if content is not None else None
            yield path, depth, idx, size, digest, content if with_content else None, error
            if content is not None and depth < max_depth and content[:2] == b"PK":
                yield from walk(content, path + "/", depth + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners, held = [], [], 0
            for i in range(batch.num_rows):
                body = batch.column(1)[i].as_py()
                if body is None:
                    continue
                found = walk(body, "", 0) if _open(body) is not None else iter([(None, None, None, None, None, None, "invalid archive")])
                for row in found:
                    rows.append(row)
                    owners.append(i)
                    held += _ROW + len(row[5] or b"")
                    if held > _FLUSH:
                        yield flush(batch, owners, rows)
                        rows, owners, held = [], [], 0
            if rows:
                yield flush(batch, owners, rows)

    def flush(batch: pa.RecordBatch, owners: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    schema = T.StructType([T.StructField(id_col, files.schema[id_col].dataType), *T.StructType.fromDDL(WALK)])
    names = schema.names
    return files.select(id_col, content_col).mapInArrow(run, schema)


def read_members(opened: DataFrame) -> DataFrame:
    """``(file_id, body, wanted)`` → one row per wanted entry: file_id, entry_idx, size, content and error, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners, held = [], [], 0
            for i in range(batch.num_rows):
                body, wanted = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                for row in read_entries(body, wanted or [], None) if body is not None else ():
                    rows.append(row)
                    owners.append(i)
                    held += _ROW + len(row[2] or b"")
                    if held > _FLUSH:
                        yield flush(batch, owners, rows)
                        rows, owners, held = [], [], 0
            if rows:
                yield flush(batch, owners, rows)

    def flush(batch: pa.RecordBatch, owners: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], schema.names)

    schema = T.StructType([T.StructField("file_id", opened.schema["file_id"].dataType), *ENTRY.fields])
    return opened.select("file_id", "body", "wanted").mapInArrow(run, schema)


@F.arrow_udf(T.BinaryType())
def zip_rebuild(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of content, dropped, new_idx and new_content: the container again without the dropped entries and with some entries' bytes replaced."""

    def one(content, dropped, new_idx, new_content):
        if not content.is_valid:
            return None
        source, out = _open(content.as_py()), io.BytesIO()
        drop, fresh = set(dropped.as_py() or []), dict(zip(new_idx.as_py() or [], new_content.as_py() or []))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
            for i, info in enumerate(source.infolist()):
                if i in drop:
                    continue
                body = fresh[i] if i in fresh else source.read(info)
                target.writestr(zipfile.ZipInfo(info.orig_filename), body, zipfile.ZIP_DEFLATED)
        return out.getvalue()

    yield from in_pieces(columns, one, pa.binary(), len)
