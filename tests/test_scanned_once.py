"""Each PDF is scanned once, by a pattern that passes other characters by, and masked by what the scan found."""

import re

from pyspark.sql import functions as F

from disarm import rules
from disarm.functions.content import SCAN_BLOCK, apply_spans
from disarm.operators import pdf
from disarm.operators.findings import findings_table
from disarm.plans.pipeline import _inspect_single

NAMES = [name for name, *_ in rules.PDF_NAMES]


def _bodies():
    joined = " ".join(NAMES) + " /AA /AA<x /AAA /AA9"
    edges = [b"%PDF" + b"." * (SCAN_BLOCK - 4 - i) + name.encode() + b"/AA\n" for name in NAMES for i in range(len(name) + 1)]
    return [b"%PDF", b"%PDF/AA", b"%PDF" + joined.encode(), b"%PDF" + joined.encode() * 300, b"%PDF/JS/JavaScript/JSx//JS\xff/AA\t\x00/GoTo/GoToRE", *edges]


def _files(spark):
    files = spark.createDataFrame([(str(i), "a.pdf", bytearray(b)) for i, b in enumerate(_bodies())], "file_id string, filename string, content binary")
    return files.withColumns({"original_type": F.lit("pdf"), "original_size": F.octet_length("content").cast("bigint")})


def test_masks_are_those_of_a_plain_search(spark):
    names = re.compile("|".join(map(re.escape, NAMES)).encode() + rb"|/AA(?=[ \t\n\r<0-9])")
    want = [names.sub(lambda m: b"/" + b"X" * (len(m[0]) - 1), b) for b in _bodies()]
    rows = _files(spark).withColumn("hits", pdf.name_hits("content")).withColumn("masks", pdf.mask_spans(F.col("hits")))
    got = rows.select("file_id", apply_spans(F.col("content"), F.col("masks")), pdf.mask(F.col("content"))).collect()
    for i, by_spans, by_names in got:
        assert bytes(by_spans) == bytes(by_names) == want[int(i)]


def test_outputs_come_from_the_hits(spark):
    done = _inspect_single(_files(spark), {"pdf"}, {"pdf"}).select("status", "output")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan  # not a pass for each name
    assert {r.status for r in done.collect()} == {"CLEAN", "SANITIZED"}


def test_findings_are_not_scanned_for_in_a_filter(spark):
    found = findings_table(_inspect_single(_files(spark), {"pdf"}, {"pdf"}))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SubmitForm") and not [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter") and "SubmitForm" in line]
    assert found.where("file_id = '2'").count() == len(NAMES) + 3


def test_patterns_start_with_the_slash():
    for pattern in (pdf.NAMES_REGEX, pdf.AA_REGEX, pdf.ACTIVE_REGEX):
        assert pattern.startswith("/") and "|/" not in pattern
