import base64
import gzip
import hashlib
import random

from pyarrow import fs

from disarm.llm import warc


def pages(spark, rng):
    html = ["", None, "<p>é</p>", "<p>é</p>", "x" * 70000] + [f"<b>{rng.randint(0, 60)}</b>" for _ in range(300)]
    rows = [(i * 3 % 311, rng.choice(["http://A.example.net/a?x=1", "https://b.example.net/", None, "no url", "http://é.org/\r\nX: y"]) if i % 2 else f"http://h{i % 7}.org/{i}", t) for i, t in enumerate(html)]
    rows += [(None, "http://h1.org/1", html[10]), rows[20], rows[20]]
    return rows, spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string").repartition(4)


def test_records_come_back_and_repeats_refer(spark, tmp_path):
    rows, frame = pages(spark, random.Random(1))
    captures = warc.write_archives(frame, folder=str(tmp_path / "archives"))
    index = warc.write_index(captures, folder=str(tmp_path / "index"), lines=7)
    got = warc.read_records(warc.wanted_pages(frame), index).collect()
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        refers = None if p == first[h or ""] else first[h or ""]
        want.append((p, "response" if refers is None else "revisit", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), refers, True, data if refers is None else b""))
    assert sorted(((*r[:6], bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    # the files are plain archives: members one after the other, each a record
    held = b"".join(p.read_bytes() for p in (tmp_path / "archives").glob("*.warc.gz"))
    assert gzip.decompress(held).count(b"WARC/1.1\r\n") == len(rows)


def test_short_payloads_are_never_revisits(spark, tmp_path):
    frame = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://a/", "longer same"), (4, "http://a/", "longer same")], "page_id long, url string, html string")
    index = warc.write_index(warc.write_archives(frame, min_bytes=5))
    assert {r.page_id: r.refers_to for r in warc.read_records(warc.wanted_pages(frame), index).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_a_search_reads_one_block(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(i, f"http://h{i % 50}.org/{i}", f"t{i}") for i in range(400)], "page_id long, url string, html string")
    index = warc.write_index(warc.write_archives(frame), lines=16).collect()
    searcher = warc.Searcher([(r.file, (bytes(r.first_key), r.first_capture), (bytes(r.last_key), r.last_capture)) for r in index])
    seen = []
    read = searcher._read
    monkeypatch.setattr(searcher, "_read", lambda *a: seen.append(a) or read(*a))
    (line,) = searcher.find(b"org,h7)/57", 57)
    assert searcher.record(line)["payload"] == b"t57"
    # the footer, the directory, a block (and the one before, for a key that opens a block), the record
    assert len(seen) in (4, 5) and sum(a[2] for a in seen if a[0] != line[3]) < 3000
    assert list(searcher.find(b"org,h7)/58", 57)) == [] and list(searcher.find(b"", 0)) == []
    assert fs.FileSystem.from_uri(line[3])[0].get_file_info(fs.FileSystem.from_uri(line[3])[1]).size >= line[4] + line[5]


def test_no_pages(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_index(warc.write_archives(frame))
    assert warc.read_records(warc.wanted_pages(frame), index).collect() == []
