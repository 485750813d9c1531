"""Tables that outlive a query: the ledger source, upserts of a stream, seen digests; and metrics from one read."""

import json
import os
import re
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from disarm import staging
from disarm.operators import metrics
from disarm.operators.seen import SeenDigests
from disarm.sources.ledger_source import load_ledger, save_ledger
from disarm.streaming import queries as sq

CLIENTS = "fingerprint string, name string, issued_s long, revoked_s long"


def fresh():
    return tempfile.mkdtemp(prefix="spark-")


def book(spark, rows):
    moment = lambda c: F.when(F.col(c).isNotNull(), F.timestamp_seconds(c))
    return spark.createDataFrame(rows, CLIENTS).select("fingerprint", "name", moment("issued_s").alias("issued_at"), moment("revoked_s").alias("revoked_at"))


def told(ledger):
    return sorted(tuple(r) for r in ledger.select("fingerprint", "name", F.unix_seconds("issued_at"), F.unix_seconds("revoked_at"), "common_name").collect())


def test_ledger_source_round_trip(spark):
    path = fresh()
    rows = [(f"fp{i}", 'né "x"\n' if i % 3 else None, 1000 + i, 2000 if i % 2 else None) for i in range(60)]
    save_ledger(book(spark, rows), path, documents=4)
    names = [n for n in os.listdir(path) if n.endswith(".json")]
    assert 1 < len(names) <= 4 and not [n for n in os.listdir(path) if n.startswith(".pending")]
    assert told(load_ledger(spark, path)) == sorted((*r, "") for r in rows)
    save_ledger(book(spark, rows[:2]), path)
    assert told(load_ledger(spark, path)) == sorted((*r, "") for r in rows[:2])
    save_ledger(book(spark, [("new", "n", 5, None)]), path, mode="append")
    assert len(told(load_ledger(spark, path))) == 3
    assert load_ledger(spark, fresh()).collect() == [] and load_ledger(spark, "/tmp/not-there").collect() == []


def test_ledger_source_refuses_other_versions(spark):
    path = fresh()
    with open(f"{path}/a.json", "w") as out:
        json.dump({"version": 2, "clients": []}, out)
    with pytest.raises(Exception, match="unsupported version 2"):
        load_ledger(spark, path).collect()
    with open(f"{path}/a.json", "w") as out:
        json.dump({"version": 1, "clients": [{"fingerprint": "x", "issued_at_unix": 7}, {"fingerprint": "x", "issued_at_unix": 9}]}, out)
    assert told(load_ledger(spark, path)) == [("x", None, 9, None, None)]


def test_a_failed_write_leaves_the_ledger_as_it_was(spark):
    path = fresh()
    save_ledger(book(spark, [("kept", "k", 1, None)]), path)
    bad = book(spark, [(f"fp{i}", "n", 1, None) for i in range(50)]).withColumn("name", F.when(F.col("fingerprint") == "fp7", F.raise_error(F.lit("boom"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="boom"):
        save_ledger(bad, path, documents=3)
    assert [r[0] for r in told(load_ledger(spark, path))] == ["kept"] and not [n for n in os.listdir(path) if n.startswith(".pending")]


def test_upserts_across_restarts(spark):
    folder, out, progress = fresh(), fresh(), fresh()
    schema = "original_type string, status string"
    rows = [(t, s) for i, t in enumerate("abcab") for s in ("CLEAN", "ERROR", "CLEAN")[: i + 1]]
    upserts = sq.Upserts(spark, out, "type string, result string, files long", ["type", "result"], fold_every=3)
    for i in range(8):
        spark.createDataFrame([r for k, r in enumerate(rows) if k % 8 == i], schema).coalesce(1).write.mode("append").parquet(folder)
        if i in (2, 3, 7):  # the query stops and starts again where it was
            got = sq.run_update(sq.running_counters(sq.stream_table(spark, folder, max_files=1)), upserts, progress)
    seen = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, metrics.files_processed(seen).collect()))
    assert sorted(map(tuple, got.collect())) == want
    written = {n: spark.read.parquet(f"{out}/batch={n}").count() for n in upserts._folders("batch")}
    assert max(written) == 7 and upserts._folders("base")[-1] == 5 and all(c <= 2 for c in written.values())
    for n in (7, 5, 0):  # batches that come again change nothing, folded in or not
        again = spark.read.parquet(f"{out}/batch={n}").collect() if n == 7 else [("a", "clean", 999)]
        upserts.write(spark.createDataFrame(again, upserts.schema), n)
        assert sorted(map(tuple, upserts.table().collect())) == want


def test_seen_digests_stay_where_they_are(spark):
    rows = [(f"d{i % 90}", i) for i in range(200)]
    found = spark.createDataFrame(rows, "sha256 string, file_id long")
    seen = SeenDigests(spark, buckets=16)
    assert seen.unseen(found).count() == 200
    for _ in range(2):  # adding again adds nothing
        seen.add(found.where("file_id % 90 < 30"))
        assert sorted(r[0] for r in seen.table().collect()) == sorted({f"d{i}" for i in range(30)})
    seen.add(spark.createDataFrame([("d40",), (None,)], "sha256 string"))
    left = seen.unseen(found)
    assert {r.sha256 for r in left.collect()} == {f"d{i}" for i in range(30, 90) if i != 40}
    plan = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    side = plan.split("Bucketed: true")[0]
    assert "Bucketed: true" in plan, plan
    assert plan.count("Exchange") == 1 and side.rfind("Exchange hashpartitioning") < side.rfind("FileScan parquet"), plan
    assert re.search(r"SelectedBucketsCount: 16 out of 16", plan)


def test_metrics_take_one_read_of_each_table(spark):
    folder = fresh()
    log = spark.createDataFrame([("pdf", "CLEAN", 0.02, 10), ("pdf", "CLEAN", 7.0, 10**9), ("zip", "ERROR", None, 5), (None, "ERROR", 0.5, None)], "original_type string, status string, duration_s double, original_size long")
    log.write.parquet(f"{folder}/log")
    spark.createDataFrame([("exif",), ("exif",), ("macro",)], "type string").write.parquet(f"{folder}/found")
    log, found = spark.read.parquet(f"{folder}/log"), spark.read.parquet(f"{folder}/found")
    lines = metrics.metric_lines(log, found)
    apart = metrics.exposition_lines(metrics.files_processed(log), metrics.threats_removed(found), metrics.duration_histogram(log), metrics.size_histogram(log))
    assert sorted(map(str, (r.line for r in lines.collect()))) == sorted(map(str, (r.line for r in apart.collect())))
    scans = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(lines) == 2 < scans(apart)


def test_threads_clear_their_own_tables(spark):
    here, ready, done = staging.stage(spark.range(3), "here"), threading.Event(), threading.Event()
    result = {}

    def other():
        since = staging.mark()
        table = staging.stage(spark.range(5), "there")
        ready.set()
        done.wait(60)
        result["rows"] = table.count()
        result["cleared"] = staging.clear_staged(spark, since)

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(60)
    since = staging.mark()
    staging.stage(spark.range(4), "mine")
    assert staging.clear_staged(spark, since) == 1
    done.set()
    thread.join()
    assert result == {"rows": 5, "cleared": 1} and here.count() == 3


def test_arrivals_of_a_stream_are_bounded_in_rows(spark):
    """A micro-batch is one arrival, and waits in the state of its keys: larger tables make more of them, not larger ones."""
    from disarm.plans.catalog import _shuffled

    rows = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 864).alias("ts"))
    stream = _shuffled(spark, rows, rows_each=100)
    sizes, ids = [], []

    def count(batch, _):
        found = [r.event_id for r in batch.select("event_id").collect()]
        sizes.append(len(found))
        ids.extend(found)

    stream.writeStream.foreachBatch(count).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) >= 10 and max(sizes) <= 130
    assert sorted(i for i in ids if i is not None) == list(range(1000))
