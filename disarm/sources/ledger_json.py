"""The ledger document: ``{"version": 1, "clients": [...]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disarm import rules
from disarm.schema import LEDGER, LEDGER_DOCUMENT


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The client records of a document; a missing one is an empty ledger, another version an error.

    Where a fingerprint occurs twice the later record counts.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], LEDGER)
    document = spark.read.schema(LEDGER_DOCUMENT).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    checked = document.withColumn(
        "clients",
        F.when(F.col("version") == rules.LEDGER_VERSION, F.col("clients")).otherwise(
            F.raise_error(F.format_string("clients ledger: unsupported version %d", "version"))
        ),
    )
    rows = checked.select(F.posexplode("clients").alias("at", "c"))
    latest = rows.groupBy("c.fingerprint").agg(F.max_by("c", "at").alias("c"))

    def moment(name: str):
        return F.when(F.col(f"c.{name}") > 0, F.timestamp_seconds(f"c.{name}"))

    return latest.select(
        "c.fingerprint", "c.name", "c.common_name", moment("issued_at_unix").alias("issued_at"),
        moment("not_after_unix").alias("not_after"), moment("revoked_at_unix").alias("revoked_at"), "c.revoke_reason",
    )


def write_ledger(ledger: DataFrame, path: str, documents: int = 1) -> None:
    """Write the ledger to a new folder, spread over so many documents by fingerprint.

    A document is put together in one group, so a ledger of millions of records wants as many documents as
    keep each one small; :func:`read_ledger` reads them all.
    """

    def unix(name: str):
        return F.coalesce(F.unix_seconds(name), F.lit(0)).alias(f"{name}_unix")

    def text(name: str):
        return (F.col(name) if name in ledger.columns else F.lit(None).cast("string")).alias(name)

    record = F.struct(
        "fingerprint", text("name"), F.coalesce(text("common_name"), F.lit("")).alias("common_name"),
        unix("issued_at"), unix("not_after"), unix("revoked_at"), text("revoke_reason"),
    )
    numbered = ledger.select(F.pmod(F.xxhash64("fingerprint"), F.lit(documents)).alias("document"), record.alias("record"))
    packed = numbered.groupBy("document").agg(F.array_sort(F.collect_list("record")).alias("clients"))
    body = F.to_json(F.struct(F.lit(rules.LEDGER_VERSION).alias("version"), "clients"))
    packed.select("document", body.alias("value")).write.partitionBy("document").text(path)
