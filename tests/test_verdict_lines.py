"""Verdict lines as a whole, against a plain version."""

import json
import re

from disarm import rules
from disarm.plans.catalog import PLAIN
from disarm.plans.derived import table
from tests.conftest import SF

NAMES = {r[0]: r for r in rules.PDF_NAMES}


def line(body):
    found = [(NAMES[m[0]], f'byte pattern "{m[0]}" at offset {len(body[:m.start()].encode())}') for m in re.finditer("|".join(NAMES), body)]
    found += [(rules.PDF_AA, f"byte offset {len(body[:m.start()].encode())}") for m in re.finditer("/AA(?=[ \t\n\r<0-9])", body)]
    threats = [{"type": r[1], "location": at, "description": r[3], "severity": r[2]} for r, at in found]
    size = len(body.encode())
    made = {"status": "sanitized" if found else "clean", "original_type": "pdf", "original_size": size, "sanitized_size": size, "threats": threats}
    return json.dumps(made, separators=(",", ":"), ensure_ascii=False)


def test_whole_lines(spark):
    want = {str(r.file_id): line(r.body) for r in table(spark, SF, "pdf_files").collect()}
    assert {r.file_id: r.line for r in PLAIN["verdict_json_whole"](spark, SF).collect()} == want
    assert any('"threats":[{' in x for x in want.values())
