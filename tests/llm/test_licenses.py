"""Notices however they are wrapped, and all of them."""

import textwrap

import pytest

from disarm.llm import licenses
from disarm.llm.licenses import CUES, TEMPLATES, Scanner
from tests.conftest import SF

SCANNER = Scanner(TEMPLATES, 0.85, 4096)
PROSE = "Stones lie in the river and nobody minds them at all. " * 60


def found(text, scanner=SCANNER):
    return [(name, form) for name, form, *_ in scanner.scan(text)]


@pytest.mark.parametrize("key", TEMPLATES)
def test_wrapping_does_not_matter(key):
    assert any(c in TEMPLATES[key].lower() for c in CUES)
    flat = " ".join(TEMPLATES[key].split())
    for width in (8, 24, 40, 60, 72, 80, 100, 2000):
        for mark in ("", "# ", " * ", "// "):
            text = PROSE + "\n" + "\n".join(mark + line for line in textwrap.wrap(flat, width, break_long_words=False, break_on_hyphens=False)) + "\n" + PROSE
            (notice,) = SCANNER.scan(text)
            assert notice[:2] == key and notice[9], (width, mark)
            assert " ".join(text[notice[2]:notice[2] + notice[3]].split()).replace(mark.strip() or "\0", "").split()[:2] == flat.split()[:2]


def test_neighbours_are_all_told():
    assert found("Released under the MIT License. Licensed under CC BY 4.0.") == [("MIT", "statement"), ("CC-BY-4.0", "statement")]
    every = list(TEMPLATES)
    assert found("\n\n".join(TEMPLATES[k] for k in every)) == every
    assert found("All rights reserved.\n" * 2000) == [("proprietary", "statement")] * 2000
    legal = "The license permits redistribution of the software in source and binary forms subject to conditions and warranty terms. " * 12
    assert found(legal + "Licensed under CC BY 4.0. " + legal) == [("CC-BY-4.0", "statement")]


def test_block_borders_cut_nothing():
    small = Scanner(TEMPLATES, 0.85, 50)
    for lead in range(0, 120, 7):
        text = "software " * lead + TEMPLATES["MIT", "text"] + " " + "license " * lead + TEMPLATES["GPL-3.0", "header"] + "\n" + PROSE
        assert found(text, small) == found(text) == [("MIT", "text"), ("GPL-3.0", "header")]
    for gap in range(0, 700, 9):
        assert found("license " + "stone " * gap + TEMPLATES["CC0-1.0", "sentence"]) == [("CC0-1.0", "sentence")]


def test_the_gain_chooses(monkeypatch):
    """Where several templates fit a place, the one that saves most has it; with equal gains another one would."""
    texts = [t for (name, _), t in licenses.TEMPLATES.items() if len(t.split()) > 20]
    scanner = lambda: licenses.Scanner(licenses.TEMPLATES, 0.85, 4096)
    found = [[f[:2] for f in scanner().scan(t)] for t in texts]
    assert all(len(f) >= 1 for f in found)
    ranked = licenses.Scanner._gains
    monkeypatch.setattr(licenses.Scanner, "_gains", lambda self, words: sorted(ranked(self, words)))
    assert [[f[:2] for f in scanner().scan(t)] for t in texts] != found


def test_templates_without_the_usual_words(spark):
    own = {("house", "rule"): "Nobody may copy this page or show it to anyone outside the building without asking first."}
    docs = spark.createDataFrame([(1, "x y. " + own["house", "rule"].upper()), (2, "Nobody may copy this page or show it to anyone outside the building without first."), (3, "nothing")], "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.exact) for r in licenses.scan_licenses(docs, templates=own).collect()) == [(1, "house", True), (2, "house", False)]


def test_whole_table_equals_a_scan_without_blocks(spark):
    """Every text of the smallest table as one block, whatever words it has, against the operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scanner, want = licenses.Scanner(licenses.TEMPLATES, 0.85, 4096), []
    for doc_id, text in [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]:
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        block = list(licenses._WORD.finditer(lower))
        want += [(doc_id, *f[1][:4], f[1][9]) for f in scanner._notices(text, block, [w[0] for w in block])]
    got = [(r.doc_id, r.license, r.form, r.start, r.length, r.exact) for r in licenses.scan_licenses(docs).collect()]
    assert sorted(got) == sorted(want) and got
