import io
import zipfile

import pytest
from pyspark.sql import functions as F

from disarm.operators.findings import findings_table
from disarm.operators.verdicts import mode_output, verdicts
from disarm.plans.pipeline import Registry, inspect_files
from tests.fixtures import CASES, MACRO, jpeg, pdf, png, random_files, svg

FILES = "file_id STRING, filename STRING, content BINARY"


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [(k, v[0], v[1]) for k, v in CASES.items()] + random_files()
    done = inspect_files(spark.createDataFrame(rows, FILES).repartition(4)).collect()
    assert len(done) == len(rows)
    return {r.file_id: r for r in done}


@pytest.mark.parametrize("name", CASES)
def test_case(outcomes, name):
    _, content, kind, status, types = CASES[name]
    row = outcomes[name]
    assert (row.original_type, row.status, [f.type for f in row.findings]) == (kind, status, types)
    assert row.original_size == len(content)
    if status in ("CLEAN", "UNSUPPORTED") and kind != "svg":
        assert bytes(row.output) == content
    if status in ("ERROR", "BLOCKED"):
        assert row.output is None and row.error_message


def test_random_bytes_give_one_verdict_each(outcomes):
    for file_id, _, content in random_files():
        assert outcomes[file_id].status in ("CLEAN", "SANITIZED", "ERROR", "UNSUPPORTED", "BLOCKED")
        assert outcomes[file_id].original_size == len(content)


def test_pdf_keeps_its_length_and_loses_its_names(outcomes):
    out = bytes(outcomes["pdf_js"].output)
    assert len(out) == len(CASES["pdf_js"][1])
    assert b"/JS" not in out and b"/Launch" not in out and b"/XFA" not in out
    body = CASES["pdf_many"][1]
    at = [int(f.location.rsplit(" ", 1)[1]) for f in outcomes["pdf_many"].findings]
    start = body.index(b"/JS")
    assert at == [start + 4 * i for i in range(3000)]


def names(content):
    return zipfile.ZipFile(io.BytesIO(bytes(content))).namelist()


def test_office_parts_are_dropped(outcomes):
    assert "word/vbaProject.bin" not in names(outcomes["docm"].output)
    assert "word/document.xml" in names(outcomes["docm"].output)
    assert "word/_rels/document.xml.rels" not in names(outcomes["docx_external"].output)


def test_archive_members_are_cleaned_in_place(outcomes):
    row = outcomes["zip_mixed"]
    assert row.findings[0].location == "macro.docm/word/vbaProject.bin"
    packed = zipfile.ZipFile(io.BytesIO(bytes(row.output)))
    assert packed.namelist() == ["clean.txt", "macro.docm"]
    assert "word/vbaProject.bin" not in names(packed.read("macro.docm"))
    inner = zipfile.ZipFile(io.BytesIO(bytes(outcomes["zip_nested"].output)))
    assert "word/vbaProject.bin" not in names(zipfile.ZipFile(io.BytesIO(inner.read("inner.zip" if "inner.zip" in inner.namelist() else "x.docm"))).read("x.docm"))
    assert outcomes["zip_nested"].findings[0].location == "x.docm/x.docm/word/vbaProject.bin"
    assert names(outcomes["zip_paths"].output) == ["ok.txt"]
    assert names(outcomes["zip_big_entry"].output) == ["ok.txt"]
    mixed = zipfile.ZipFile(io.BytesIO(bytes(outcomes["zip_svg_png"].output)))
    assert b"onload" not in mixed.read("a.svg") and b"tEXt" not in mixed.read("b.png") and b"/JS" not in mixed.read("c.pdf")


def test_images_lose_metadata_only(outcomes):
    assert bytes(outcomes["jpeg_meta"].output) == jpeg()
    assert bytes(outcomes["png_text"].output) == png()
    assert b"NETSCAPE" not in bytes(outcomes["gif_meta"].output)


def test_svg_keeps_what_is_visible(outcomes):
    assert bytes(outcomes["svg_bad"].output) == svg('<a xlink:href="">t</a><rect/>')
    assert bytes(outcomes["svg_nested_drop"].output) == svg("<g><rect/></g>")
    assert bytes(outcomes["svg_style"].output) == svg("<style>p{}</style>")
    assert bytes(outcomes["svg_external"].output) == svg("<image/><rect/>")


def test_modes_and_findings(spark):
    files = spark.createDataFrame([("a", "a.docm", MACRO), ("b", "b.docx", b"PK\x03\x04x")], FILES)
    done = inspect_files(files).join(files.select("file_id", "content"), "file_id")
    for mode, same in (("ENFORCE", False), ("REPORT_ONLY", True), ("BYPASS_WITH_REPORT", True)):
        row = {r.file_id: r for r in mode_output(done.withColumn("mode", F.lit(mode))).collect()}["a"]
        assert (bytes(row.output) == MACRO) is same and row.sanitized_size == len(row.output)
    blocked = mode_output(done.withColumn("mode", F.lit("ENFORCE")), on_blocked="original").where("file_id = 'b'").first()
    assert bytes(blocked.output) == b"PK\x03\x04x"
    assert [r.type for r in findings_table(done).collect()] == ["macro"]
    assert {r.file_id: r.max_severity for r in verdicts(done).collect()} == {"a": "critical", "b": None}


def test_registry_last_registration_wins(spark):
    def flag(label):
        def run(rows):
            return rows.select(
                "file_id", F.lit(label).alias("status"), F.array().cast("array<struct<type: string, location: string, description: string, severity: string>>").alias("findings"),
                F.lit(None).cast("string").alias("error_message"), F.col("content").alias("output"),
            )
        return run

    registry = Registry()
    registry.register(["pdf"], flag("BLOCKED"))
    registry.register(["pdf"], flag("CLEAN"))
    files = spark.createDataFrame([("a", "a.pdf", pdf(b"/JS"))], FILES)
    assert inspect_files(files, registry).first().status == "CLEAN"
