"""Files as ordered chunks: putting uploads together under a cap, and cutting outputs up again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disarm import rules


def assemble_chunks(chunks: DataFrame, max_size: int = rules.MAX_FILE_BYTES) -> DataFrame:
    """``(request_id, seq, chunk)`` → one row per request: ``content``, or ``file_too_large``.

    Sizes are summed first, before anything is gathered, so a request over the cap is turned away
    without its chunks ever meeting in one task; what is gathered is bounded by the cap.
    """
    length = F.octet_length("chunk").cast("bigint")
    sizes = chunks.groupBy("request_id").agg(F.sum(length).alias("size"))
    too_large = sizes.where(F.col("size") > max_size).select(
        "request_id", F.lit(None).cast("binary").alias("content"), "size", F.lit("file_too_large").alias("reject_reason")
    )
    fitting = chunks.where(length > 0).join(too_large.select("request_id"), "request_id", "left_anti")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda p: p["chunk"])
    text = F.array_join(F.transform(ordered, lambda c: F.decode(c, "ISO-8859-1")), "")
    gathered = fitting.groupBy("request_id").agg(F.encode(text, "ISO-8859-1").alias("content"))
    whole = gathered.select(
        "request_id", "content", F.octet_length("content").cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("reject_reason"),
    )
    empty = sizes.where("size = 0").select(
        "request_id", F.lit(bytearray(b"")).alias("content"), "size", F.lit(None).cast("string").alias("reject_reason")
    )
    return too_large.unionByName(whole).unionByName(empty)


def split_chunks(files: DataFrame, size: int = rules.CHUNK_BYTES) -> DataFrame:
    """``(file_id, content)`` → 64 KiB chunks in order; an empty file gives no rows."""
    total = F.octet_length("content")
    starts = F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(size)))
    pieces = F.transform(starts, lambda s: F.substring(F.col("content"), s + 1, F.lit(size)))
    return files.select("file_id", F.posexplode(pieces).alias("seq", "chunk"))
