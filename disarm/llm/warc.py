"""WARC archives with a two-level capture index.

Tasks write archives of records that are compressed one by one, and report where each record lies. Captures are
then sorted by reversed host and path and written as index files: compressed blocks of lines, and behind them a
sparse directory with the first key of each block. A search goes by binary search from the index files' bounds
to the directory, to one block, to one line, and reads just that block and that record.

Files go to the shared staging folder through Arrow's file systems. A task that is run again writes a file under
a new name; only files that a finished task reported are ever read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm.llm.url_filter import url_host
from disarm.staging import new_folder, stage

LINES = 512  # captures in a block of the index
DATE = "1970-01-01T00:00:00Z"  # of captures, where the table has none
_NONE = -(2**63)  # stands for a missing page id in keys
_FOOTER, _FOOTER_SIZE = "<QQ", 16  # place and size of the directory

CAPTURES = "page_id long, capture long, key binary, file string, at long, size long"


def url_key(url: Column) -> Column:
    """Labels of the host in reverse order, then what follows the host; as bytes, so that all sort alike."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit(""))
    return F.encode(F.concat(F.array_join(F.reverse(F.split(url_host(url), "[.]")), ","), F.lit(")"), rest), "UTF-8")


def _place(folder: str, name: str) -> tuple[fs.FileSystem, str, str]:
    files, path = fs.FileSystem.from_uri(folder)
    return files, path, f"{folder}/{name}"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit has the HTTP header, with the payload's size, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = lambda lines: {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    headers = named(head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(headers["content-length"])].partition(b"\r\n\r\n")
    return {"headers": headers, "http": named(http.decode().split("\r\n")[1:]), "payload": payload}


def write_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)``; where each lies comes back, as CAPTURES.

    The payload is the html in UTF-8; a null one is empty. Of equal payloads of at least ``min_bytes`` bytes,
    those of the smallest page_id are responses (all rows with it, if rows repeat), the others revisit it.
    A null page_id is larger than any other and is never referred to. Other columns are ignored.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    sized = F.octet_length("html") >= min_bytes
    # written before the join, so that Spark can split the rows of a frequent payload; only repeated payloads are in it
    first = stage(named.where(sized).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 AND first IS NOT NULL").select("digest", "first"), "first-captures")
    refers = F.when(sized & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    ready = named.join(first, "digest", "left").select(
        "page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), F.octet_length("html").alias("n"), "digest", refers.alias("refers_to"), url_key(F.col("url")).alias("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path, name = _place(folder, f"{uuid.uuid4().hex}.warc.gz")
        files.create_dir(path, recursive=True)
        at = 0
        with files.open_output_stream(f"{path}/{name.rsplit('/', 1)[1]}", compression=None) as out:
            for batch in batches:
                made = []
                for r in batch.itertuples(index=False):
                    page_id, refers_to = (None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to))
                    digest = base64.b32encode(bytes.fromhex(r.digest)).decode()
                    data = gzip.compress(record(page_id, r.url, (r.html or "").encode(), int(r.n), digest, refers_to), 6, mtime=0)
                    out.write(data)
                    made.append((page_id, _NONE if page_id is None else page_id, r.key, name, at, len(data)))
                    at += len(data)
                yield pd.DataFrame(made, columns=["page_id", "capture", "key", "file", "at", "size"]).astype({"page_id": "Int64"})

    return stage(ready.mapInPandas(run, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str | None = None, lines: int = LINES) -> DataFrame:
    """Write index files over CAPTURES; one row per file comes back: file, first and last (key, capture), n."""
    spark = captures.sparkSession
    folder = folder or new_folder(spark, "warc-index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path, name = _place(folder, f"{uuid.uuid4().hex}.idx")
        files.create_dir(path, recursive=True)
        directory, held, at, n, first, last = [], [], 0, 0, None, None
        with files.open_output_stream(f"{path}/{name.rsplit('/', 1)[1]}", compression=None) as out:
            def flush() -> None:
                nonlocal at, held
                data = zlib.compress(json.dumps(held).encode())
                directory.append((held[0][0], held[0][1], at, len(data)))
                out.write(data)
                at, held = at + len(data), []

            for batch in batches:
                for r in batch.itertuples(index=False):
                    last = (r.key, int(r.capture))
                    first = first or last
                    held.append((r.key.hex(), int(r.capture), None if pd.isna(r.page_id) else int(r.page_id), r.file, int(r.at), int(r.size)))
                    n += 1
                    if len(held) == lines:
                        flush()
            if held:
                flush()
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data + struct.pack(_FOOTER, at, len(data)))
        if n:
            yield pd.DataFrame([(name, *first, *last, n)], columns=["file", "first_key", "first_capture", "last_key", "last_capture", "n"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = captures.repartitionByRange(width, "key", "capture").sortWithinPartitions("key", "capture")
    return stage(placed.mapInPandas(run, "file string, first_key binary, first_capture long, last_key binary, last_capture long, n long"), "index-files")


class Searcher:
    """Searches index files and reads records; one per task, with a few files and one block at hand."""

    def __init__(self, index: list[tuple[str, tuple[bytes, int], tuple[bytes, int]]]) -> None:
        self._index = sorted(index, key=lambda f: f[1])
        self._firsts = [f[1] for f in self._index]
        self._open, self._directory, self._block = lru_cache(32)(self._opened), lru_cache(4)(self._listed), lru_cache(4)(self._lines)

    @staticmethod
    def _opened(file: str):
        files, path = fs.FileSystem.from_uri(file)
        return files.open_input_file(path)

    def _read(self, file: str, at: int, size: int) -> bytes:
        return self._open(file).read_at(size, at)

    def _listed(self, file: str) -> tuple[list[tuple[bytes, int]], list[tuple[int, int]]]:
        end = self._open(file).size()
        at, size = struct.unpack(_FOOTER, self._read(file, end - _FOOTER_SIZE, _FOOTER_SIZE))
        listed = json.loads(zlib.decompress(self._read(file, at, size)))
        return [(bytes.fromhex(k), c) for k, c, _, _ in listed], [(a, s) for _, _, a, s in listed]

    def _lines(self, file: str, at: int, size: int) -> list[tuple]:
        return [(bytes.fromhex(k), c, *rest) for k, c, *rest in json.loads(zlib.decompress(self._read(file, at, size)))]

    def find(self, key: bytes, capture: int) -> Iterator[tuple]:
        """All index lines of a key and capture; repeated captures may reach into the next block or file."""
        wanted = (key, capture)
        at = max(0, bisect_left(self._firsts, wanted) - 1)
        for file, first, last in self._index[at:]:
            if first > wanted:
                return
            if last < wanted:
                continue
            keys, places = self._directory(file)
            for k in range(max(0, bisect_left(keys, wanted) - 1), bisect_right(keys, wanted)):
                lines = self._block(file, *places[k])
                lo = bisect_left(lines, wanted, key=lambda x: x[:2])
                while lo < len(lines) and lines[lo][:2] == wanted:
                    yield lines[lo]
                    lo += 1

    def record(self, line: tuple) -> dict:
        return parse_record(gzip.decompress(self._read(line[3], line[4], line[5])))


RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, verified boolean, payload binary"


def read_records(wanted: DataFrame, index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``wanted(key, capture)``, found through the index files; each record once.

    ``verified``: a response's payload has the size and digest that its headers state.
    """
    # one row per index file, so as many as the index has partitions, whatever the number of captures
    listed = [(r.file, (bytes(r.first_key), r.first_capture), (bytes(r.last_key), r.last_capture)) for r in index.collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(listed)
        for batch in batches:
            made = []
            for r in batch.itertuples(index=False):
                for line in searcher.find(r.key, int(r.capture)):
                    found = searcher.record(line)
                    headers, payload = found["headers"], found["payload"]
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(found["http"]["content-length"])
                    revisit = headers["warc-type"] == "revisit"
                    fine = not payload if revisit else len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
                    refers_to = int(headers["warc-refers-to"][len("<urn:page:"):-1]) if revisit else None
                    made.append((line[2], headers["warc-type"], size, digest, refers_to, fine, payload if payloads else None))
            yield pd.DataFrame(made, columns=[c.split()[0] for c in RECORDS.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    width = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sought = wanted.select("key", "capture").distinct().repartitionByRange(width, "key", "capture").sortWithinPartitions("key", "capture")
    return sought.mapInPandas(run, RECORDS)


def wanted_pages(pages: DataFrame) -> DataFrame:
    """Keys to search for, of ``pages(page_id, url)``."""
    return pages.select(url_key(F.col("url")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(_NONE)).alias("capture"))
