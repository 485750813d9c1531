"""What a Python worker holds follows neither the batch it is given nor the table."""

import io
import os
import zipfile

import pyarrow as pa
import pytest

from disarm.functions import zips
from disarm.plans.derived import archive_of, zip_bytes
from disarm.plans.pipeline import inspect_files
from disarm.staging import ARROW_BATCH_BYTES

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
MIB = 1 << 20


@pytest.fixture(scope="module")
def archives():
    return [zip_bytes([("a.bin", os.urandom(MIB)), ("word/_rels/a.rels", os.urandom(MIB)), ("../b", b"x")]) for _ in range(12)]


def held(pieces):
    """Rows of all pieces; none of them may be much over the bound."""
    pieces = list(pieces)
    assert len(pieces) > 1 and max(p.nbytes for p in pieces) < zips._FLUSH + 3 * MIB
    return [v for p in pieces for v in p.to_pylist()]


def test_rebuilt_archives_leave_in_pieces(archives):
    n = len(archives)
    batch = tuple(pa.array(c, k) for c, k in (
        ([*archives, None], pa.binary()), ([[2]] * n + [None], pa.list_(pa.int32())),
        ([[0]] * n + [None], pa.list_(pa.int32())), ([[b"new"]] * n + [None], pa.list_(pa.binary()))))
    *made, last = held(zips.zip_rebuild.func(iter([batch])))
    assert len(made) == n and last is None
    for was, now in zip(archives, made):
        was, now = (zipfile.ZipFile(io.BytesIO(b)) for b in (was, now))
        assert now.namelist() == ["a.bin", "word/_rels/a.rels"]
        assert now.read("a.bin") == b"new" and now.read("word/_rels/a.rels") == was.read("word/_rels/a.rels")


def test_parts_leave_in_pieces(archives):
    n = len(archives)
    batch = (pa.array(archives), pa.array([[0, 1]] * n, pa.list_(pa.int32())), pa.array([[1]] * n, pa.list_(pa.int32())))
    made = held(zips.zip_parts.func(iter([batch])))
    assert [[(p["entry_idx"], p["size"], p["content"] is None) for p in row] for row in made] == [[(0, MIB, True), (1, MIB, False)]] * n


def test_derived_archives_leave_in_pieces():
    batch = (pa.array([os.urandom(MIB).hex() for _ in range(12)]), pa.array([0] * 12, pa.int32()))
    made = held(archive_of.func(iter([batch])))
    assert [zipfile.ZipFile(io.BytesIO(b)).read("a.txt").decode() for b in made] == batch[0].to_pylist()


def test_batches_are_bounded_unless_the_session_bounds_them(spark):
    files = spark.createDataFrame([("f", "a.zip", zip_bytes([("a", b"x")]))], "file_id string, filename string, content binary")
    session = files.sparkSession
    given = session.conf.get(BOUND, None)
    try:
        session.conf.unset(BOUND)
        inspect_files(files)
        assert int(session.conf.get(BOUND).rstrip("b")) == ARROW_BATCH_BYTES
        session.conf.set(BOUND, "1m")
        inspect_files(files)
        assert session.conf.get(BOUND) == "1m"
    finally:
        session.conf.set(BOUND, given) if given else session.conf.unset(BOUND)
