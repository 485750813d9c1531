"""Lenient reading of markup, and how its time grows."""

import time

import pytest

from disarm.operators.markup import inspect_markup, markup_findings, strip_markup

PAGES = {
    'plain <b class="x">text</b>': 'plain <b class="x">text</b>',
    "<svg/onload=alert(1)>": "<svg>",
    '<img src="x"onerror="alert(1)">': '<img src="x">',
    "<img src='x'onerror='alert(1)'alt='y'>": "<img src='x'alt='y'>",
    "<p onclick>t</p>": "<p>t</p>",
    "<div><object><p>x</object><b>keep</b></div>": "<div><b>keep</b></div>",
    "<div><object><p>x</div><b>keep</b>": "<div></div><b>keep</b>",
    "<p>a<script>if (a < b) x('</p>')</script>b": "<p>ab",
    "<p>a<script>never closed <b>x": "<p>a",
    "a < b and <i>c</i>": "a < b and <i>c</i>",
    '<a href="&#x0000000006A;avascript:x()">t</a>': '<a href="">t</a>',
    '<a href="&#106avascript:x()">t</a>': '<a href="">t</a>',
    "<a href=javascript:x()>t</a>": '<a href="">t</a>',
    '<embed src="x"></embed>z': "z",
    '<!-- <script> --><style>p{}</style><style>p{-moz-binding:url(x)}</style>': "<!-- <script> --><style>p{}</style>",
    "": "",
}


def test_pages_are_stripped(spark):
    frame = spark.createDataFrame([(p, p.encode()) for p in PAGES], "file_id string, content binary")
    got = {r.file_id: bytes(r.content).decode() for r in strip_markup(frame).collect()}
    assert got == PAGES
    clean = {p for p, out in PAGES.items() if p == out}
    assert {r.file_id for r in markup_findings(frame).collect()} == set(PAGES) - clean


@pytest.mark.parametrize("part", [b"<!--", b"<![CDATA[", b"<?", b"<script>", b'<a "', b"<a '\"", b"<!doctype [", b"<", b"</a>"])
def test_a_megabyte_of_openers_is_read_in_no_time(spark, part):
    frame = spark.createDataFrame([("f", b"<svg>" + part * (1_000_000 // len(part)))], "file_id string, content binary")
    inspect_markup(frame.limit(0)).collect()
    started = time.perf_counter()
    assert inspect_markup(frame).first().status in ("ERROR", "BLOCKED")
    assert time.perf_counter() - started < 20


def test_nothing_is_shuffled(spark):
    frame = spark.createDataFrame([("f", b"<svg/>")], "file_id string, content binary")
    for df in (inspect_markup(frame), strip_markup(frame), markup_findings(frame)):
        assert "Exchange" not in df._jdf.queryExecution().toString()


def test_a_token_takes_few_bytes_in_python():
    """A batch of documents has millions of tokens; they are kept by column, not as an object each."""
    import tracemalloc

    from disarm.functions import tags

    data, n = b"<p a='1'>x</p>" * 20_000, 40_000
    tags._Columns().arrow()  # what Arrow imports at first is not counted
    tracemalloc.start()
    into = tags._Columns()
    tags._read(data, frozenset(), frozenset(), 10**6, into)
    made = into.arrow()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made.field("tokens")[0]) == n and peak < 100 * n


def test_documents_of_a_batch_keep_their_tokens():
    from disarm.functions import tags

    into = tags._Columns()
    for data in (b"<a>x</a>", b"<b><b><b><b>", b"", b"<c/>tail"):
        tags._read(data, frozenset(["a"]), frozenset(), 3, into)
    got = into.arrow().to_pylist()
    assert [t and [(x["kind"], x["element"], x["start"], x["length"], x["opens"]) for x in t] for t in (g["tokens"] for g in got)] == [
        [("start", "a", 0, 3, True), ("end", "a", 4, 4, False)], None, [], [("empty", "c", 0, 4, False)]]
    assert [g["n_tokens"] for g in got] == [3, 4, 0, 2] and [g["tail"] for g in got] == [8, None, 0, 4]
