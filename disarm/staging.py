"""Staged tables: cut a plan at a written table in the cluster's shared folder.

A staged table survives the loss of executors and fixes values (such as a range
partition number) that must not differ between two readings of the same rows.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_here = threading.local()


def _written() -> list[str]:
    """Folders written by this thread and not yet cleared, oldest first. Each micro-batch runs in its stream's own thread, so
    streams and queries that stage at the same time never clear each other's tables."""
    if not hasattr(_here, "folders"):
        _here.folders = []
    return _here.folders


def staging_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a local folder is made for a local master only: on a cluster every machine
    would write to a disk of its own, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


ARROW_BATCH_BYTES = 8 << 20
_BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ARROW_BATCH_BYTES in a session that sets no bound of its own.

    A Python worker has a whole batch of content in memory, and a task several workers in a row.
    """
    if spark.conf.get(_BATCH_BOUND, None) is None:
        spark.conf.set(_BATCH_BOUND, str(ARROW_BATCH_BYTES))


def new_folder(spark: SparkSession, label: str) -> str:
    """The path of a fresh folder below the staging folder; it goes when :func:`clear_staged` is called."""
    path = f"{staging_dir(spark)}/disarm-{label}-{uuid.uuid4().hex}"
    _written().append(path)
    return path


def stage(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to a fresh folder below the staging folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many folders this thread has staged by now; hand it to :func:`clear_staged` to keep those."""
    return len(_written())


def clear_staged(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete the folders this thread staged after ``since``, and before ``until`` if given; call it once nothing reads them any more."""
    folders = _written()
    gone, folders[since:until] = folders[since:until], []
    jvm = spark._jvm
    for path in gone:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(gone)


RANGE_ROWS = 2_000_000


def range_width(df: DataFrame, rows: int) -> int:
    """How many ranges an ordered table of so many rows is cut into: the shuffle width, or one per RANGE_ROWS."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(width, -(-rows // RANGE_ROWS))
