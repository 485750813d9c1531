"""The corpus pipeline: toxic documents go, one of each group of near copies stays, contaminated documents go,
and the rest is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``, whatever else those may be. A null
text is clean, has no copies, and is packed as an empty text. Rows that are equal in id and text are copies of
each other, even without words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disarm.llm import decontaminate, jaccard_join, packing, toxicity
from disarm.staging import new_folder

TOXIC_FROM = 0.3  # documents of this score or more are rejected


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scores(F.col("text"), model) < TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = jaccard_join.jaccard_components(docs).where("kept").select("key")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("doc"), jaccard_join.row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where(~F.col("contaminated")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, ["doc_id", "piece", "start"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL has no learned grammar and no tokenizer; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage_of(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
