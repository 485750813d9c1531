"""Every query over whole tables of the smallest scale: against its SQL twin, or for the shape of its result."""

import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from disarm.llm import toxicity
from disarm.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.llm.test_decontaminate import plain as contaminated
from tests.llm.test_jaccard_join import plain as grouped

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert {*QUERIES, "pipeline"} <= contract.queries().keys() and ORACLES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", ORACLES)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    done = con.execute(ORACLES[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in done.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want and want


def test_vectors_and_scores(spark):
    rows = QUERIES["op10_vector_dedup"](spark, SF).collect()
    assert len(rows) == 500 and all(r.audited_recall >= 0.99 for r in rows)
    scores = QUERIES["op7_toxicity"](spark, SF).collect()
    assert len(scores) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores)


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9001, None, "xx", None, None), (9002, "", "en", "s", 0), (None, "alone", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(2)).withColumn("key", F.lit("clash")).withColumn("doc", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("contaminated", F.lit(True))
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        held[name] = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    toxic, near, clean, packed = (held[n] for n, _ in corpus_pipeline.STAGES)
    reader = toxicity.Reader(toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
    assert len([d for d, t in toxic if reader.score(t) < 0.3]) == pytest.approx(len(near), abs=2)  # its model saw the added rows
    once = list({(d, t): None for d, t in near})
    keep = {c for d, n, c in grouped(once) if n} | {d for d, n, _ in grouped(once) if not n}
    assert sorted(d for d, _ in clean if d is not None) == sorted(d for d in keep if d is not None)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(d for d, _ in packed if d is not None) == sorted(r[0] for r in contaminated(clean, items) if not r[5] and r[0] is not None)
    assert {r.doc_id for r in docs.collect()} == {d for d, _ in packed}


def test_the_rest_stands_alone(monkeypatch):
    for gone in [m for m in sys.modules if m.startswith(("disarm.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, gone)
    monkeypatch.setitem(sys.modules, "disarm.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as alone

    assert not [q for q in alone.queries() if q.startswith(("op", "pipeline")) and q[2:3].isdigit()] and "pipeline" not in alone.queries()
