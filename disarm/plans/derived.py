"""Tables of files and security events derived from the given tables.

One SQL text per table serves both Spark and the comparison engine. ``{name}`` stands for a given or
derived table.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disarm.functions.zips import in_pieces

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations")
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def zip_bytes(entries: list[tuple[str, bytes]]) -> bytes:
    """A small container with fixed dates."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for name, body in entries:
            target.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


_DOCX_HEX = zip_bytes([("[Content_Types].xml", b"<Types/>"), ("word/document.xml", b"<w/>")]).hex().upper()
_XLSX_HEX = zip_bytes([("Word/a.xml", b"<w/>"), ("xl/workbook.xml", b"<x/>"), ("word/b.xml", b"<w/>")]).hex().upper()
_PPTX_HEX = zip_bytes([("docProps/app.xml", b"<p/>"), ("ppt/presentation.xml", b"<p/>"), ("word/late.xml", b"<w/>")]).hex().upper()
_DEEP_HEX = zip_bytes([("backup/ppt/presentation.xml", b"<p/>"), ("a.xlsx", b"x")]).hex().upper()
_ZIP_HEX = zip_bytes([("a.txt", b"plain text")]).hex().upper()

VIEWS: dict[str, str] = {
    "pdf_files": """
SELECT doc_id AS file_id, concat('doc-', doc_id, '.pdf') AS filename,
  concat('%PDF-1.4', chr(10), text, CASE doc_id % 8
    WHEN 0 THEN ' /JS (x) /Launch ' WHEN 1 THEN ' /AA << /OpenAction 4 0 R >> '
    WHEN 2 THEN ' /AAA /EmbeddedFiles /XFA ' WHEN 3 THEN ' /GoToR /GoToE /Movie /Sound ' WHEN 4 THEN ' /AA' ELSE '' END) AS body
FROM {documents}""",
    "typed_files": f"""
SELECT doc_id AS file_id,
  CASE doc_id % 14 WHEN 6 THEN 'text.PDF' WHEN 7 THEN 'a.tar.gz' WHEN 10 THEN 'bad.xlsx' WHEN 11 THEN 'dir.zip/bad.bin'
    WHEN 12 THEN 'p.jpg' ELSE 'x.bin' END AS filename,
  CASE doc_id % 14 WHEN 0 THEN '25504446' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '89504E470D0A1A0A' WHEN 3 THEN '474946383761'
    WHEN 4 THEN '474946383961' WHEN 5 THEN '3C3F786D6C3F3E3C53564720' WHEN 8 THEN '{_DOCX_HEX}' WHEN 9 THEN '{_ZIP_HEX}'
    WHEN 10 THEN '504B0304' WHEN 11 THEN '504B0304' WHEN 13 THEN '{_XLSX_HEX}' ELSE '' END AS head_hex,
  CASE WHEN doc_id % 14 IN (8, 9, 13) THEN '' ELSE text END AS body
FROM {{documents}}""",
    # packages whose first part below word/, xl/ or ppt/ tells their type, and containers without one, under misleading names
    "office_files": f"""
SELECT doc_id AS file_id, CASE doc_id % 3 WHEN 0 THEN 'x.docx' WHEN 1 THEN 'x.zip' ELSE 'x' END AS filename,
  CASE doc_id % 5 WHEN 0 THEN '{_DOCX_HEX}' WHEN 1 THEN '{_XLSX_HEX}' WHEN 2 THEN '{_PPTX_HEX}' WHEN 3 THEN '{_DEEP_HEX}' ELSE '{_ZIP_HEX}' END AS body_hex
FROM {{documents}}""",
    "entries": """
SELECT archive_id, entry_idx, k, size,
  CASE k % 18 WHEN 0 THEN 'word/vbaProject.bin' WHEN 1 THEN 'src/Module1.VBA' WHEN 2 THEN 'run.vbs' WHEN 3 THEN 'run.VBE'
    WHEN 4 THEN 'a/job.wsf' WHEN 5 THEN 'word/embeddings/oleObject1.bin' WHEN 6 THEN 'word/activeX/activeX1.xml'
    WHEN 7 THEN 'xl/connections.xml' WHEN 8 THEN '../../etc/passwd' WHEN 9 THEN '/abs/path.txt' WHEN 10 THEN concat(chr(92), 'srv', chr(92), 'x.txt')
    WHEN 11 THEN repeat('n', 5000) WHEN 12 THEN 'xl/workbook.xml' WHEN 13 THEN 'ppt/presentation.xml'
    WHEN 14 THEN 'word/_rels/document.xml.rels' WHEN 15 THEN 'inner.zip' WHEN 16 THEN 'word/document.xml'
    ELSE concat('part-', k, '.txt') END AS name,
  k % 89 = 0 AS read_error,
  CASE k % 23 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'SANITIZED' WHEN 2 THEN 'ERROR' ELSE 'CLEAN' END AS member_status
FROM (SELECT l_orderkey AS archive_id, l_linenumber AS entry_idx, max(l_partkey) AS k,
        CAST(sum(CAST(floor(l_extendedprice * 510) AS BIGINT)) AS BIGINT) AS size
      FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS g""",
    "rels_parts": """
SELECT doc_id AS archive_id, CAST(doc_id % 7 AS INT) AS entry_idx,
  CASE doc_id % 3 WHEN 0 THEN 'word/_rels/document.xml.rels' WHEN 1 THEN '_rels/.RELS' ELSE 'word/document.xml' END AS name,
  concat('<Relationships>', text, CASE doc_id % 5 WHEN 0 THEN '<R TargetMode="External" Target="https://e.example/"/>'
    WHEN 1 THEN '<R TARGETMODE="EXTERNAL" Target="media/a.png"/>' WHEN 2 THEN '<R Target="http://e.example/"/>'
    WHEN 3 THEN '<R targetmode="external"/><R target="ftp://e.example/"/>' ELSE '' END, '</Relationships>') AS body
FROM {documents}""",
    "attrs": """
SELECT event_id AS file_id, event_id AS tok_idx,
  CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'circle' ELSE 'image' END AS element,
  CASE event_id % 8 WHEN 0 THEN 'onclick' WHEN 1 THEN 'href' WHEN 2 THEN 'xlink:href' WHEN 3 THEN 'style' WHEN 4 THEN 'src' WHEN 5 THEN 'fill' WHEN 6 THEN 'on' ELSE 'HREF' END AS attr,
  CASE event_id % 7 WHEN 0 THEN ' JavaScript:alert(1)' WHEN 1 THEN 'https://x.example/' WHEN 2 THEN 'width: expression(1)' WHEN 3 THEN '#local' WHEN 4 THEN 'red' WHEN 5 THEN 'behavior:url(x)' ELSE '//x.example/' END AS value
FROM {events}""",
    "style_texts": """
SELECT event_id AS file_id, concat('p{width:', CASE event_id % 6 WHEN 0 THEN 'EXPRESSION(1)' WHEN 1 THEN '1px;background:url(javascript:x)'
    WHEN 2 THEN '1px;-moz-Binding:url(x)' WHEN 3 THEN 'expression(1);-moz-binding:url(y)' ELSE '2px' END, '}', event_type) AS css
FROM {events}""",
    # marker code, name and payload of JPEG segments, one to seven per file
    "segments": """
SELECT file_id, seg_idx, k,
  CASE k % 9 WHEN 0 THEN 'APP0' WHEN 1 THEN 'APP1' WHEN 2 THEN 'APP2' WHEN 3 THEN 'APP15' WHEN 4 THEN 'COM' WHEN 5 THEN 'DB' WHEN 6 THEN 'APP1' WHEN 7 THEN 'APP1' ELSE 'C0' END AS marker,
  CASE k % 9 WHEN 0 THEN 'FFE0' WHEN 1 THEN 'FFE1' WHEN 2 THEN 'FFE2' WHEN 3 THEN 'FFEF' WHEN 4 THEN 'FFFE' WHEN 5 THEN 'FFDB' WHEN 6 THEN 'FFE1' WHEN 7 THEN 'FFE1' ELSE 'FFC0' END AS code_hex,
  CASE k % 9 WHEN 1 THEN '457869660000882541' WHEN 6 THEN '457869660000414141' WHEN 7 THEN '687474703A2F2F6E732E61646F62652E636F6D2F7861702F312E302F004141' WHEN 8 THEN '080010002003012200021101031101' ELSE '41' END AS payload_hex
FROM (SELECT l_orderkey AS file_id, l_linenumber AS seg_idx, max(l_partkey) AS k FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS g""",
    # three JPEG segments per file
    "jpeg_files": """
SELECT o_orderkey AS file_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'FFE0000341' WHEN 1 THEN 'FFE1000B457869660000882541' WHEN 2 THEN 'FFE2000341' WHEN 3 THEN 'FFEF000341' WHEN 4 THEN 'FFFE000341' WHEN 5 THEN 'FFDB000341'
    WHEN 6 THEN 'FFE1000B457869660000414141' WHEN 7 THEN 'FFE1001F687474703A2F2F6E732E61646F62652E636F6D2F7861702F312E302F00' ELSE 'FFC0000B080010002001011100' END AS s1,
  CASE o_custkey % 9 WHEN 0 THEN 'FFE0000341' WHEN 1 THEN 'FFE1000B457869660000882541' WHEN 2 THEN 'FFE2000341' WHEN 3 THEN 'FFEF000341' WHEN 4 THEN 'FFFE000341' WHEN 5 THEN 'FFDB000341'
    WHEN 6 THEN 'FFE1000B457869660000414141' WHEN 7 THEN 'FFE1001F687474703A2F2F6E732E61646F62652E636F6D2F7861702F312E302F00' ELSE 'FFC0000B080010002001011100' END AS s2,
  CASE (o_orderkey + o_custkey) % 9 WHEN 0 THEN 'FFE0000341' WHEN 1 THEN 'FFE1000B457869660000882541' WHEN 2 THEN 'FFE2000341' WHEN 3 THEN 'FFEF000341' WHEN 4 THEN 'FFFE000341' WHEN 5 THEN 'FFDB000341'
    WHEN 6 THEN 'FFE1000B457869660000414141' WHEN 7 THEN 'FFE1001F687474703A2F2F6E732E61646F62652E636F6D2F7861702F312E302F00' ELSE 'FFC0000B080010002001011100' END AS s3
FROM {orders}""",
    "png_chunks": """
SELECT l_orderkey AS file_id, l_linenumber AS seg_idx, max(l_partkey) AS k,
  CASE max(l_partkey) % 8 WHEN 0 THEN 'tEXt' WHEN 1 THEN 'zTXt' WHEN 2 THEN 'iTXt' WHEN 3 THEN 'eXIf' WHEN 4 THEN 'iCCP' WHEN 5 THEN 'tIME' WHEN 6 THEN 'IDAT' ELSE 'text' END AS marker
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # header, then a PNG or a GIF by parity; the GIF has a comment and, for some, an application block
    "raster_files": """
SELECT o_orderkey AS file_id, CASE o_orderkey % 2 WHEN 0 THEN 'png' ELSE 'gif' END AS original_type,
  CAST(o_custkey % 30000 + 1 AS BIGINT) AS width, CAST(o_orderkey % 20000 + 1 AS BIGINT) AS height,
  CASE o_orderkey % 2 WHEN 0 THEN
    concat('89504E470D0A1A0A0000000D49484452', lpad(hex(CAST(o_custkey % 30000 + 1 AS BIGINT)), 8, '0'), lpad(hex(CAST(o_orderkey % 20000 + 1 AS BIGINT)), 8, '0'), '080200000000000000')
  ELSE concat('474946383961',
    substr(lpad(hex(CAST(o_custkey % 30000 + 1 AS BIGINT)), 4, '0'), 3, 2), substr(lpad(hex(CAST(o_custkey % 30000 + 1 AS BIGINT)), 4, '0'), 1, 2),
    substr(lpad(hex(CAST(o_orderkey % 20000 + 1 AS BIGINT)), 4, '0'), 3, 2), substr(lpad(hex(CAST(o_orderkey % 20000 + 1 AS BIGINT)), 4, '0'), 1, 2), '000000',
    repeat('2C', CAST(o_custkey % 400 AS INT)), CASE o_orderkey % 3 WHEN 0 THEN '21FE0141003B' WHEN 1 THEN '21FF0B4E45545343415045322E300301000000213B' ELSE '21FF0B4E' END) END AS body_hex
FROM {orders}""",
    "requests": """
SELECT doc_id AS file_id, concat('req-', doc_id) AS request_id, CAST(n_chars AS BIGINT) * 5000 AS content_length,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'default' WHEN 2 THEN 'aggressive' ELSE 'default' END AS profile,
  CASE doc_id % 3 WHEN 0 THEN 'ENFORCE' WHEN 1 THEN 'REPORT_ONLY' ELSE 'BYPASS_WITH_REPORT' END AS mode,
  concat('p', doc_id % 11) AS policy_version
FROM {documents}""",
    "verdict_log": """
SELECT event_id, ts, CASE user_id % 9 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'pptx' WHEN 4 THEN 'jpeg' WHEN 5 THEN 'png' WHEN 6 THEN 'gif' WHEN 7 THEN 'svg' ELSE 'zip' END AS original_type,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'CLEAN' WHEN 'click' THEN 'SANITIZED' WHEN 'signup' THEN 'BLOCKED' ELSE 'UNSUPPORTED' END AS status,
  CASE user_id % 4 WHEN 0 THEN 'ENFORCE' WHEN 1 THEN 'REPORT_ONLY' ELSE 'BYPASS_WITH_REPORT' END AS mode, 'default' AS profile,
  CASE event_type WHEN 'click' THEN event_id % 5 + 1 WHEN 'signup' THEN 1 ELSE 0 END AS n_findings,
  concat('failed on ', event_id) AS error_message,
  value AS duration_s, CAST(floor(value * 100000) AS BIGINT) AS original_size
FROM {events}""",
    # three in five events are errors, so that there are streaks
    "error_log": """
SELECT event_id, ts, original_type, CASE WHEN status IN ('ERROR', 'CLEAN', 'BLOCKED') THEN 'ERROR' ELSE status END AS status FROM {verdict_log}""",
    "finding_log": """
SELECT event_id AS file_id, CASE event_id % 4 WHEN 0 THEN 'macro' WHEN 1 THEN 'javascript' WHEN 2 THEN 'exif' ELSE 'external_ref' END AS type,
  CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN CASE user_id % 2 WHEN 0 THEN 'critical' ELSE 'high' END ELSE 'medium' END AS severity
FROM {events} WHERE event_type IN ('click', 'signup')""",
    "ledger_events": """
SELECT event_id, ts, concat('sha256:', user_id % 40) AS fingerprint,
  CASE WHEN event_type = 'signup' THEN 'add' ELSE 'revoke' END AS action
FROM {events} WHERE event_type IN ('signup', 'error')""",
    "revocations": """
SELECT event_id, ts FROM {events} WHERE event_type = 'error' AND value > 150""",
    "client_attempts": """
SELECT event_id, ts, concat('sha256:', user_id % 60) AS fingerprint FROM {events} WHERE event_type = 'view'""",
    "token_events": """
SELECT event_id, ts, concat('tok-', user_id) AS token, CASE WHEN event_type = 'signup' THEN 'issue' ELSE 'attempt' END AS action
FROM {events} WHERE event_type IN ('signup', 'purchase')""",
    "rotations": """
SELECT event_id, ts, concat('fp-', event_id % 4) AS fingerprint, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 6 END AS grace_hours
FROM {events} WHERE event_type = 'signup'""",
    "pin_attempts": """
SELECT event_id, ts, concat('fp-', event_id % 4) AS fingerprint FROM {events} WHERE event_type = 'view'""",
    "downloads": """
SELECT event_id AS id, ts AS created_at, CAST(floor(value * 200000) AS BIGINT) AS size FROM {events} WHERE event_type = 'click'""",
    "certs": """
SELECT o_orderkey AS cert_id, o_orderdate AS not_after FROM {orders}""",
    "pages_injected": """
SELECT page_id AS file_id, concat(html, CASE page_id % 6 WHEN 0 THEN '<iframe src="x"></iframe>' WHEN 1 THEN '<a href="javascript:x()">y</a>' WHEN 2 THEN '<p onclick="x()">y</p>' WHEN 3 THEN '<style>p{-moz-binding:url(x)}</style>' WHEN 4 THEN '<a href="https://e.example/">y</a>' ELSE '' END) AS html
FROM {pages}""",
    "svg_files": """
SELECT p_partkey AS file_id, concat('<svg xmlns="http://www.w3.org/2000/svg"><title>', p_name, '</title>', CASE p_partkey % 8
    WHEN 0 THEN '<script>alert(1)</script><rect width="1"/>' WHEN 1 THEN '<circle onclick="x()" r="3"/>'
    WHEN 2 THEN '<a href="java&#115;cript:x()"><rect/></a>' WHEN 3 THEN '<foreignObject><p onclick="x">q</p></foreignObject><g/>'
    WHEN 4 THEN '<style>p{width:expression(1)}</style><rect style="behavior:url(x)"/>' WHEN 5 THEN '<use xlink:href="https://e.example/#a"/>'
    WHEN 6 THEN '<g><rect>' ELSE '<rect x="1"/><!-- <script> -->' END, '</svg>') AS body
FROM {part}""",
    "chunk_rows": """
SELECT concat('conv-', conv_id) AS request_id, turn AS seq, text FROM
  (SELECT conv_id, turn, max(text) AS text FROM {conversations} GROUP BY conv_id, turn) AS g""",
    "tag_rows": """
SELECT event_id, user_id, event_type, CASE event_id % 4 WHEN 0 THEN repeat('k', 65) WHEN 1 THEN '' WHEN 2 THEN 'Direction' ELSE 'dest_category' END AS odd_key,
  CASE user_id % 3 WHEN 0 THEN repeat('v', 300) ELSE concat('v', user_id) END AS odd_value
FROM {events}""",
}


_NAME = re.compile(r"\{(\w+)\}")


def depends_on(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in GIVEN or n in VIEWS]


def instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps are read as UTC, whatever the session's zone is."""
    zoneless = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    micros = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {}))"
    return df.withColumns({name: F.expr(micros.format(name)) for name in zoneless}) if zoneless else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one built on them."""
    if name in GIVEN:
        df = instants(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        # for tables whose content sits in one file that Spark cannot split; unset, nothing is moved
        parts = spark.conf.get("disarm.contentPartitions", None)
        return df.repartition(int(parts)) if parts and name in ("documents", "pages") else df
    deps = {dep: table(spark, sf_dir, dep) for dep in depends_on(VIEWS[name])}
    return spark.sql(_escaped(name), **deps)


def view_over(spark: SparkSession, name: str, source: DataFrame) -> DataFrame:
    """A derived table that needs one table only, over another form of it (a stream, say)."""
    (dep,) = depends_on(VIEWS[name])
    return spark.sql(_escaped(name), **{dep: source})


def _escaped(name: str) -> str:
    """The SQL with all braces doubled for the formatter, but for those around a table name."""
    text = re.sub(r"[{}]", lambda m: m.group() * 2, VIEWS[name])
    for dep in depends_on(VIEWS[name]):
        text = text.replace("{{" + dep + "}}", "{" + dep + "}")
    return text


def with_views(sql: str) -> str:
    """The same tables as common table expressions in front of a comparison query."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in GIVEN or name in ordered:
            return
        for dep in depends_on(VIEWS[name]):
            visit(dep)
        ordered.append(name)

    for name in depends_on(sql):
        visit(name)
    fill = lambda text: _NAME.sub(lambda m: m[1] if m[1] in GIVEN or m[1] in VIEWS else m[0], text)
    ctes = ",\n".join(f"{name} AS ({fill(VIEWS[name])})" for name in ordered)
    text = fill(sql).strip()
    if ctes and text.startswith("WITH "):
        return f"WITH {ctes},\n{text.removeprefix('WITH ')}"
    return (f"WITH {ctes}\n" if ctes else "") + text


@F.arrow_udf(T.BinaryType())
def archive_of(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of text and variant: an archive built around a text: clean, with an unsafe name, with a macro document, or nested too deep."""

    def macro(data):
        return zip_bytes([("word/document.xml", data), ("word/vbaProject.bin", b"m")])

    def deep(data):
        for _ in range(4):
            data = zip_bytes([("inner.zip", data)])
        return data

    entries = {
        0: lambda data: [("a.txt", data)],
        1: lambda data: [("a.txt", data), ("../up.txt", data)],
        2: lambda data: [("a.txt", data), ("macro.docm", macro(data))],
        3: lambda data: [("n.zip", zip_bytes([("in/macro.docm", macro(data)), ("a.txt", data)]))],
        4: lambda data: [("deep.zip", deep(data))],
        5: lambda data: [],
    }

    def one(text, variant):
        return zip_bytes(entries[variant.as_py()](text.as_py().encode()))

    yield from in_pieces(columns, one, pa.binary(), len)
