"""Queries over the whole corpus, against plain versions."""

import re

import pytest

from disarm import rules
from disarm.plans.catalog import PLAIN
from disarm.plans.derived import table
from tests.conftest import SF

NAMES = {name.encode(): kind for name, kind, *_ in rules.PDF_NAMES}
SEVERITY = {kind: severity for _, kind, severity, _ in rules.PDF_NAMES}
SVG = [
    [("script", "<script> element", "critical")], [("event_handler", "onclick attribute on <circle>", "high")],
    [("javascript_uri", "href attribute on <a>", "critical")], [("foreign_object", "<foreignObject> element", "high")],
    [("css_expression", "<style> element", "high"), ("dangerous_css", "style attribute on <rect>", "high")],
    [("external_ref", "href attribute on <use>", "medium")], [], []]
#: By variant of the typed files: text after a magic number or an extension is no image, markup or container.
TYPED = [
    ("pdf", None), ("jpeg", "ERROR"), ("png", "ERROR"), ("gif", "ERROR"), ("gif", "ERROR"), ("svg", "ERROR"), ("pdf", "ERROR"),
    ("unknown", "UNSUPPORTED"), ("docx", "CLEAN"), ("zip", "CLEAN"), ("xlsx", "ERROR"), ("unknown", "UNSUPPORTED"), ("jpeg", "ERROR"), ("xlsx", "CLEAN")]


def pdf_findings(body):
    named = [(NAMES[m[0]], f'byte pattern "{m[0].decode()}" at offset {m.start()}', SEVERITY[NAMES[m[0]]]) for m in re.finditer(b"|".join(NAMES), body)]
    return named + [("auto_action", f"byte offset {m.start()}", "high") for m in re.finditer(rb"/AA(?=[ \t\n\r<0-9])", body)]


@pytest.fixture(scope="module")
def plain(spark):
    """Type, status, findings and size of every file."""
    out = {}
    for r in table(spark, SF, "pdf_files").collect():
        found = pdf_findings(r.body.encode())
        out[f"pdf-{r.file_id}"] = "pdf", "SANITIZED" if found else "CLEAN", found, len(r.body.encode())
    for r in table(spark, SF, "svg_files").collect():
        found = SVG[r.file_id % 8]
        out[f"svg-{r.file_id}"] = "svg", "SANITIZED" if found else "CLEAN", found, len(r.body.encode())
    for r in table(spark, SF, "typed_files").collect():
        content = bytes.fromhex(r.head_hex) + r.body.encode()
        kind, status = TYPED[r.file_id % 14]
        found = [] if status else pdf_findings(content)
        out[f"any-{r.file_id}"] = kind, status or ("SANITIZED" if found else "CLEAN"), found, len(content)
    assert {int(k[4:]) % 14 for k in out if k.startswith("any-")} == set(range(14))
    return out


@pytest.mark.parametrize("name", ["inspect_verdicts_whole", "stream_inspect_whole"])
def test_verdicts(spark, plain, name):
    rank = rules.SEVERITIES.index
    want = {k: (t, s, len(f), max((x[2] for x in f), key=rank, default=None), n) for k, (t, s, f, n) in plain.items()}
    rows = PLAIN[name](spark, SF).collect()
    assert {r.file_id: (r.original_type, r.status, r.n_findings, r.max_severity, r.original_size) for r in rows} == want
    assert len(rows) == len(want)


def test_findings(spark, plain):
    want = sorted((k, seq, x[0], x[1]) for k, (_, _, f, _) in plain.items() for seq, x in enumerate(f))
    assert sorted(tuple(r) for r in PLAIN["inspect_findings_whole"](spark, SF).collect()) == want
