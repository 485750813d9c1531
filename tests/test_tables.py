"""Column functions, sources, chunks and the streaming forms."""

import json
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from disarm.functions.content import apply_spans, pattern_hits
from disarm.functions.names import base_name, extension
from disarm.functions.zips import ArchiveEntries
from disarm.operators import admission, archive, chunks, metrics
from disarm.plans.pipeline import inspect_files
from disarm.sources import files, ledger_json
from disarm.streaming import queries as sq
from disarm.streaming import stateful as ss
from disarm.staging import mark
from tests.fixtures import MACRO, archive as zip_of, pdf, svg


def fresh():
    return os.path.join(tempfile.mkdtemp(prefix="spark-"), uuid.uuid4().hex)


def test_names(spark):
    df = spark.createDataFrame([("a/b.TXT",), ("a/",), ("",), ("//",), ("x.tar.gz",), ("a.b/c",), ("dot.",)], "n STRING")
    got = [tuple(r) for r in df.select(base_name(F.col("n")), extension(F.col("n"))).collect()]
    assert got == [("b.TXT", "txt"), ("a", ""), (".", ""), ("/", ""), ("x.tar.gz", "gz"), ("c", ""), ("dot.", "")]


def test_pattern_hits_across_blocks(spark):
    body = b"".join(b"\xe9" * gap + b"/Launch" for gap in (2043, 2040, 0, 1, 4090))
    want = [i for i in range(len(body)) if body.startswith(b"/Launch", i)]
    df = spark.createDataFrame([(bytearray(body),), (bytearray(b""),)], "content BINARY")
    got = [[h.offset for h in r[0]] for r in df.select(pattern_hits("content", "/JS|/Launch", 7)).collect()]
    assert got == [want, []]


def test_apply_spans(spark):
    df = spark.createDataFrame([(bytearray(bytes(range(200, 220))),)], "c BINARY")
    def span(s, n, r):
        return F.struct(F.lit(s).alias("start"), F.lit(n).alias("len"), F.lit(bytearray(r)).alias("replacement"))
    got = df.select(apply_spans(F.col("c"), F.array(span(0, 2, b""), span(5, 0, b"XY"), span(18, 2, b"Z")))).first()[0]
    body = bytes(range(200, 220))
    assert bytes(got) == body[2:5] + b"XY" + body[5:18] + b"Z"


def test_archive_table_function(spark):
    df = spark.createDataFrame([("z", bytearray(zip_of([("a", b"1"), ("b", b"22")]))), ("bad", bytearray(b"x"))], "id STRING, c BINARY")
    rows = df.lateralJoin(ArchiveEntries(F.col("c").outer(), F.lit(None).cast("array<int>"))).select("id", "entry_idx", "size", "error").collect()
    assert {(r.id, r.entry_idx, r.size) for r in rows} == {("z", 0, 1), ("z", 1, 2), ("bad", None, None)}


def test_running_totals_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(archive, "ENTRY_BLOCK", 4)
    size = 11 * 1024 * 1024
    rows = [("hot", i, f"e{i}", size) for i in range(30)] + [("small", 0, "e", size)]
    df = spark.createDataFrame(rows, "archive_id STRING, entry_idx INT, name STRING, size LONG")
    assert [tuple(r) for r in archive.zip_bomb(df).collect()] == [("hot", 9, size * 10)]
    assert {r.running // size for r in archive.running_totals(df).where("archive_id = 'hot'").collect()} == set(range(1, 31))


def test_tags_and_profiles(spark):
    tags = {f"k{i:02}": "v" for i in range(20)} | {"": "x", "k" * 65: "x", "long": "v" * 257, "Direction": "in"}
    df = spark.createDataFrame([(tags,)], "tags MAP<STRING, STRING>")
    kept = df.select(admission.cap_tags(F.col("tags"))).first()[0]
    assert len(kept) == 16 and "" not in kept and "long" not in kept
    assert df.select(admission.metric_labels(F.col("tags"))).first()[0] == {"Direction": "in"}
    assert admission.capability_matrix(admission.profiles(spark)).count() == 11


def test_histogram_counts_every_bound(spark):
    df = spark.createDataFrame([(0.05,), (0.5,)], "duration_s DOUBLE")
    got = {r.le: r.cumulative for r in metrics.duration_histogram(df).collect()}
    assert got == {0.01: 0, 0.05: 1, 0.1: 1, 0.5: 2, 1.0: 2, 5.0: 2, 10.0: 2, 30.0: 2}


def test_chunks_round_trip_and_cap(spark):
    df = spark.createDataFrame([("a", bytearray(b"x" * 150_000)), ("b", bytearray(b""))], "file_id STRING, content BINARY")
    cut = chunks.split_chunks(df)
    assert [(r.file_id, r.seq, len(r.chunk)) for r in cut.orderBy("seq").collect()] == [("a", 0, 65536), ("a", 1, 65536), ("a", 2, 18928)]
    back = chunks.assemble_chunks(cut.withColumnRenamed("file_id", "request_id"))
    assert bytes(back.first().content) == b"x" * 150_000
    assert chunks.assemble_chunks(cut.withColumnRenamed("file_id", "request_id"), max_size=1000).first().reject_reason == "file_too_large"


def test_read_and_stream_files(spark):
    folder = fresh()
    os.makedirs(folder)
    for name, body in {"a.pdf": pdf(b"/JS 1"), "b.svg": svg('<g onload="x"/>'), "c.docm": MACRO, "big.bin": b"x" * 5000}.items():
        with open(os.path.join(folder, name), "wb") as out:
            out.write(body)
    table = files.read_files(spark, folder, max_size=4000)
    reasons = {r.filename: (r.content is None, r.reject_reason, r.content_length) for r in table.collect()}
    assert reasons.pop("big.bin") == (True, "file_too_large", 5000) and {v[:2] for v in reasons.values()} == {(False, None)}
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,4000)]" in plan and "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan
    batch = {r.file_id.rsplit("/", 1)[1]: r.status for r in inspect_files(table).collect()}
    assert batch == {"a.pdf": "SANITIZED", "b.svg": "SANITIZED", "c.docm": "SANITIZED", "big.bin": "ERROR"}
    out, before = fresh(), mark()
    sq.inspect_stream(files.stream_files(spark, folder, max_files=2, max_size=4000), out, fresh()).awaitTermination()
    assert mark() == before  # what the batches staged is gone
    streamed = {r.file_id.rsplit("/", 1)[1]: r.status for r in spark.read.parquet(out).collect()}
    assert streamed == batch
    sq.inspect_stream(files.stream_files(spark, folder, max_files=2, max_size=4000), out, fresh()).awaitTermination()
    assert spark.read.parquet(out).count() == 4  # the same batches again replace their folders
    clean = fresh()
    files.write_clean(inspect_files(table), table, clean)
    assert {r.filename for r in spark.read.parquet(clean).collect()} == {"sanitized_a.pdf", "sanitized_b.svg", "sanitized_c.docm"}


def test_ledger_document(spark):
    assert ledger_json.read_ledger(spark, fresh()).count() == 0
    path = fresh()
    os.makedirs(path)
    record = {"fingerprint": "f", "common_name": "cn", "issued_at_unix": 5, "not_after_unix": 9, "revoked_at_unix": 0}
    with open(f"{path}/l.json", "w") as out:
        json.dump({"version": 1, "clients": [record, record | {"common_name": "new"}]}, out)
    book = ledger_json.read_ledger(spark, path)
    assert [(r.fingerprint, r.common_name, r.revoked_at) for r in book.collect()] == [("f", "new", None)]
    copy = fresh()
    ledger_json.write_ledger(book, copy)
    assert [tuple(r) for r in ledger_json.read_ledger(spark, copy).collect()] == [tuple(r) for r in book.collect()]
    with open(f"{path}/l.json", "w") as out:
        json.dump({"version": 2, "clients": []}, out)
    with pytest.raises(Exception, match="unsupported version"):
        ledger_json.read_ledger(spark, path).collect()


def in_batches(spark, df, time, n=3):
    """The same rows as a stream of files in time order."""
    path = fresh()
    rows = df.orderBy(time).collect()
    for i in range(n):
        part = rows[len(rows) * i // n : len(rows) * (i + 1) // n]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return sq.stream_table(spark, path, max_files=1)


def test_uploads_across_batches(spark):
    rows = [("a", 1, b"B", True, 1), ("b", 0, b"x" * 60, False, 1), ("c", 0, b"half", False, 1), ("a", 1, b"B", True, 1), ("e", 0, b"again", False, 1), ("e", 0, b"again", False, 2), ("e", 2, b"!", True, 2), ("a", 0, b"A", False, 2), ("b", 1, b"x" * 60, True, 2), ("d", 0, b"later", True, 5000)]
    df = spark.createDataFrame(rows, "request_id STRING, seq INT, chunk BINARY, is_last BOOLEAN, s LONG").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    out = sq.run_append(ss.assemble_stream(in_batches(spark, df, "ts"), max_size=100), fresh(), fresh()).collect()
    got = {r.request_id: (bytes(r.content) if r.content is not None else None, r.reject_reason) for r in out}
    assert got == {"a": (b"AB", None), "b": (None, "file_too_large"), "c": (None, "upload_timeout"), "e": (None, "upload_timeout"), "d": (b"later", None)}


def test_sql_functions(spark):
    from disarm.functions.register import register

    register(spark)
    spark.createDataFrame(
        [("z", bytearray(zip_of([("a", b"1"), ("b", b"22")])))], "id STRING, content BINARY"
    ).createOrReplaceTempView("files")
    rows = spark.sql("SELECT id, e.entry_idx, e.size FROM files, LATERAL archive_entries(content, CAST(NULL AS ARRAY<INT>)) AS e")
    assert {tuple(r) for r in rows.collect()} == {("z", 0, 1), ("z", 1, 2)}
    assert [e.name for e in spark.sql("SELECT zip_listing(content) AS l FROM files").first().l] == ["a", "b"]


def test_types_left_out_pass_through(spark):
    df = spark.createDataFrame([("a", "a.pdf", pdf(b"/JS 1")), ("b", "b.docm", MACRO)], "file_id STRING, filename STRING, content BINARY")
    got = {r.file_id: (r.original_type, r.status) for r in inspect_files(df, types=["pdf"]).collect()}
    assert got == {"a": ("pdf", "SANITIZED"), "b": ("docx", "UNSUPPORTED")}


def test_a_silent_inspector_loses_no_file(spark):
    from disarm.operators.findings import no_findings
    from disarm.plans.pipeline import Registry

    def half(df):
        return df.where("file_id = 'a'").select("file_id", F.lit("CLEAN").alias("status"), no_findings().alias("findings"), F.lit(None).cast("string").alias("error_message"), F.col("content").alias("output"))

    registry = Registry()
    registry.register(["pdf"], half)
    df = spark.createDataFrame([("a", "a.pdf", pdf(b"/JS 1")), ("b", "b.pdf", pdf(b"/JS 1"))], "file_id STRING, filename STRING, content BINARY")
    assert {r.file_id: r.status for r in inspect_files(df, registry).collect()} == {"a": "CLEAN", "b": "ERROR"}


def test_jpeg_metadata_between_scans(spark):
    from disarm.functions.segments import walk_jpeg

    scan = b"\xff\xda\x00\x04\x01\x00" + b"\x12\xff\x00\x34\xff\xd0\x56"
    data = b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00" + scan + b"\xff\xfe\x00\x06geo!" + scan + b"\xff\xd9tail"
    assert [m for m, _, _ in walk_jpeg(data)] == ["C2", "SOS", "COM", "SOS", "TRAILER"]
    assert [m for m, _, _ in walk_jpeg(data[:-6])] == ["C2"]
    df = spark.createDataFrame([("a", "a.jpg", data)], "file_id STRING, filename STRING, content BINARY")
    row = inspect_files(df).first()
    assert row.status == "SANITIZED" and b"geo!" not in bytes(row.output) and bytes(row.output).endswith(b"\xff\xd9")


def test_unknown_png_chunks_go(spark):
    from tests.fixtures import chunk, png

    body = png(chunk(b"tEXt", b"a\0b") + chunk(b"prIv", b"secret") + chunk(b"gAMA", b"\0\0\0\1"))
    df = spark.createDataFrame([("a", "a.png", body)], "file_id STRING, filename STRING, content BINARY")
    out = bytes(inspect_files(df).first().output)
    assert b"secret" not in out and b"tEXt" not in out and b"gAMA" in out
