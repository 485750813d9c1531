"""Fingerprints of PEM blocks, those with an empty body and of odd texts included."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from disarm.functions.digests import pem_fingerprint

TEXTS = [None, "", " ", "\n", "a", "ab", "abc", "\0", "é" * 40, "x" * 57, "x" * 58, "-----BEGIN X-----\nAAAA\n-----END X-----\n", "-----END CERTIFICATE-----"]


def of(body):
    return "sha256:" + hashlib.sha256(body).hexdigest()


def test_first_block(spark):
    def block(body, kind="CERTIFICATE"):
        return f"-----BEGIN {kind}-----{body}-----END {kind}-----\n"

    der = bytes(range(256))
    lines = base64.encodebytes(der).decode()
    want = [
        (None, None), ("", None), ("no block", None), ("-----BEGIN X-----\n", None), ("-----END X-----\n", None),
        (block(""), of(b"")), (block("\n"), of(b"")), (block("\r\n \t\n"), of(b"")),
        (block("\n" + lines), of(der)), (block("\r\n" + lines.replace("\n", "\r\n")), of(der)),
        ("text before\n" + block("\n" + lines) + block("\nAAAA\n", "X"), of(der)), (block("\n") + block("\n" + lines), of(b"")),
    ]
    rows = spark.createDataFrame([(i, pem) for i, (pem, _) in enumerate(want)], "i int, pem string")
    got = dict(rows.select("i", pem_fingerprint(F.col("pem"))).collect())
    assert [got[i] for i in range(len(want))] == [fingerprint for _, fingerprint in want]


def test_odd_texts_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(contract.oracle_sql()["pem_fingerprint"]).fetchall()
    got = contract.queries()["pem_fingerprint"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert dict(want)[1] == of(b"")
