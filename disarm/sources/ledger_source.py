"""The client ledger as a data source: ``spark.read.format("ledger")`` and ``df.write.format("ledger")``.

A ledger is a folder of documents ``{"version": 1, "clients": [...]}``. Each document is a partition of the reader. Each
task of the writer streams one document into a pending folder; they move into place when all tasks are done, and go when one
failed. Any file system that Arrow can open will do.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from disarm import rules

_RECORD = "fingerprint string, name string, common_name string, issued_at_unix long, not_after_unix long, revoked_at_unix long, revoke_reason string"
_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _RECORD.split(", ")] + [("place", pa.string())])
_BATCH = 10_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Document(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_Document]:
        files, folder = _opened(self.path)
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".json"))
        return [_Document(n) for n in names]

    def read(self, partition: _Document) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Document):  # an empty ledger has no documents
            return
        files, _ = _opened(self.path)
        with files.open_input_stream(partition.path) as source:
            document = json.loads(source.read())
        if document.get("version") != rules.LEDGER_VERSION:
            raise ValueError(f"clients ledger: unsupported version {document.get('version')}")
        clients = document.get("clients") or []
        name = posixpath.basename(partition.path)
        for at in range(0, len(clients), _BATCH):
            rows = [c | {"place": f"{name}:{at + i:012}"} for i, c in enumerate(clients[at:at + _BATCH])]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    records: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.pending = path, overwrite, f".pending-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Written:
        files, folder = _opened(self.path)
        files.create_dir(f"{folder}/{self.pending}", recursive=True)
        target, count = f"{folder}/{self.pending}/clients-{uuid.uuid4().hex}.json", 0
        with files.open_output_stream(target) as out:
            out.write(b'{"version":%d,"clients":[' % rules.LEDGER_VERSION)
            for row in iterator:
                record = {k: v for k, v in row.asDict().items() if v is not None}
                out.write((b"," if count else b"") + json.dumps(record, ensure_ascii=False, separators=(",", ":")).encode())
                count += 1
            out.write(b"]}")
        return _Written(target, count)

    def commit(self, messages: list[_Written]) -> None:
        files, folder = _opened(self.path)
        old = [f.path for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and f.base_name.endswith(".json")]
        for m in messages:
            if m is not None and m.records:
                files.move(m.path, f"{folder}/{posixpath.basename(m.path)}")
        for path in old if self.overwrite else ():
            files.delete_file(path)
        self._tidy(files, folder)

    def abort(self, messages: list[_Written]) -> None:
        self._tidy(*_opened(self.path))

    def _tidy(self, files: fs.FileSystem, folder: str) -> None:
        if files.get_file_info(f"{folder}/{self.pending}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.pending}")


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return f"{_RECORD}, place string"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def save_ledger(ledger: DataFrame, path: str, documents: int | None = None, mode: str = "overwrite") -> None:
    """Write client records to a ledger, one document for each of ``documents`` tasks (the shuffle width, if not given).

    Records are dealt by fingerprint, so a document is as large as its share of them. Missing columns are left out.
    """
    def unix(name: str):
        at = F.unix_seconds(name) if name in ledger.columns else F.lit(0).cast("long")
        return F.coalesce(at, F.lit(0)).alias(f"{name}_unix")

    def text(name: str):
        return (F.col(name) if name in ledger.columns else F.lit(None)).cast("string").alias(name)

    ledger.sparkSession.dataSource.register(LedgerSource)
    records = ledger.select(
        "fingerprint", text("name"), F.coalesce(text("common_name"), F.lit("")).alias("common_name"),
        *map(unix, ("issued_at", "not_after", "revoked_at")), text("revoke_reason"))
    dealt = records.repartition(documents, "fingerprint") if documents else records.repartition("fingerprint")
    dealt.write.format("ledger").mode(mode).save(path)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The client records of a ledger; one that isn't there is empty. Of a fingerprint's records the last one counts."""
    spark.dataSource.register(LedgerSource)
    rows = spark.read.format("ledger").load(path)
    latest = rows.groupBy("fingerprint").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("fingerprint", "place")]), "place").alias("c"))

    def moment(name: str):
        return F.when(F.col(f"c.{name}_unix") > 0, F.timestamp_seconds(f"c.{name}_unix")).alias(name)

    return latest.select("fingerprint", "c.name", "c.common_name", moment("issued_at"), moment("not_after"), moment("revoked_at"), "c.revoke_reason")
