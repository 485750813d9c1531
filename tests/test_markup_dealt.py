"""Markup that lies in one file split is inspected by many tasks."""

from pyspark.sql import functions as F

from disarm.plans.pipeline import inspect_files


def test_drawings_of_one_split_go_to_all_tasks(spark):
    rows = [(f"f{i}", "x.svg", bytearray(b"<svg><g onclick='x()'/></svg>")) for i in range(400)]
    files = spark.createDataFrame(rows, "file_id string, filename string, content binary").coalesce(1)
    done = inspect_files(files).select("file_id", "status", F.size("findings").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert sorted(r.file_id for r in done) == sorted(r[0] for r in rows)
    assert {(r.status, r.n) for r in done} == {("SANITIZED", 1)}
    assert len({r.task for r in done}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
