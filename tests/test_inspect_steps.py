"""Inspection does each step once: drawings are dealt over files, a stream's corpus is written once, rules see a value once."""

import pytest
from pyspark.sql import functions as F

from disarm.functions.content import SCAN_BLOCK, pattern_hits
from disarm.operators import markup
from disarm.plans import catalog
from disarm.plans.pipeline import inspect_files
from tests.conftest import SF


def test_drawings_lie_in_many_files(spark):
    drawings = catalog.corpus(spark, SF).where("file_id LIKE 'svg-%'")
    assert drawings.select(F.input_file_name()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["stream_inspect", "stream_inspect_whole"])
def test_corpus_of_a_stream_is_not_written_twice(spark, monkeypatch, name):
    staged = []
    monkeypatch.setattr(catalog, "stage", lambda df, label, *by: staged.append(label) or df)
    monkeypatch.setattr(catalog, "_inspected_stream", lambda spark, files: files)
    files = (catalog.QUERIES | catalog.PLAIN)[name](spark, SF)
    assert not staged
    want = {r[0] for r in catalog.corpus(spark, SF, whole=name.endswith("whole")).select("file_id").collect()}
    assert sorted(r[0] for r in files.select("file_id").collect()) == sorted(want)


def test_attributes_are_read_once_for_findings_and_once_for_the_clean_tag(spark):
    files = spark.createDataFrame([("a", bytearray(b"<svg><g onclick='x()' id='&#97;' href=' java&#115;cript:y' style='a&amp;expression(1)'/></svg>"))], "file_id string, content binary")
    done = markup.inspect_markup(files)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(markup._ATTRIBUTE_NAME) == 2
    row = done.first()
    assert bytes(row.output) == b"<svg><g id='&#97;' href=\"\"/></svg>"
    assert [f.type for f in row.findings] == ["event_handler", "javascript_uri", "dangerous_css"]


def test_only_images_wait_for_the_image_walk(spark):
    files = spark.createDataFrame([("a", "a.pdf", bytearray(b"%PDF/JS")), ("b", "b.gif", bytearray(b"GIF89a"))], "file_id string, filename string, content binary")
    done = inspect_files(files)
    plan = done._jdf.queryExecution().optimizedPlan().toString().splitlines()
    walks = [i for i, line in enumerate(plan) if "ArrowEvalPython" in line and "image_segments" in line]
    assert walks
    for i in walks:  # what feeds the walk is filtered by type
        feed = next(line for line in plan[i + 1:] if "Filter" in line)
        assert "IN (gif,jpeg,png)" in feed and "NOT" not in feed.split("IN (gif,jpeg,png)")[0][-300:]
    assert sorted((r.file_id, r.status) for r in done.collect()) == [("a", "SANITIZED"), ("b", "ERROR")]


def test_blocks_without_the_lead_are_passed_by(spark):
    bodies = [b"", b"/", b"x" * SCAN_BLOCK + b"/JS", b"x" * (SCAN_BLOCK - 1) + b"/JS" + b"y" * SCAN_BLOCK + b"/Launch", b"/JS" * 2000]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "i int, content binary")
    led, all_ = (pattern_hits("content", "/(?:JS|Launch)", 7, *lead) for lead in ((b"/",), ()))
    rows = df.select("i", led.alias("led"), all_.alias("all")).collect()
    assert all(r.led == r.all and len(r.all) == bodies[r.i].count(b"/JS") + bodies[r.i].count(b"/Launch") for r in rows)
