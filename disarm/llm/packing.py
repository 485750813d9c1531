"""Best-fit packing: plan on counts of lengths, then documents take planned slots by rank within length.

The plan works on at most ``capacity`` numbers, whatever the number of documents. Longest first, all pieces
of a length go at once into the bins with the least room that still holds them; bins of equal room form
ranges, so the plan is a short list of runs: so many pieces of that length, from that rank on, in bins of
consecutive numbers at that offset. Ranks are made in salted groups, as one length may have most of the rows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disarm.llm.tokens import little_endian, token_ids, tokenizer_path
from disarm.staging import stage

_BYTES = 4 << 20  # ids held in a task before they are handed on
PLAN_RUNS = 1_000_000  # runs of a plan (40 bytes each) that go to all tasks; longer plans are joined by length


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, and a first one with what is left over."""
    count = -(-n // capacity)
    first = n - capacity * (count - 1)
    return [(0, first)] + [(first + capacity * i, capacity) for i in range(count - 1)]


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None
) -> DataFrame:
    """``id_col``, piece, start, length and ids (little-endian unsigned 32-bit) for all pieces of all texts.

    A text is its ids and then ``end_id``; a null text is empty. Texts longer than ``capacity`` are cut.
    """
    path = path or tokenizer_path()
    end = array("I", [end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made, size = [], [], 0
            for i in range(batch.num_rows):
                ids = little_endian(token_ids(batch.column(1)[i].as_py() or "", path) + end)
                for k, (start, length) in enumerate(_cut(len(ids) // 4, capacity)):
                    rows.append(i)
                    made.append((k, start, length, ids[4 * start:4 * (start + length)]))
                size += len(ids)
                if size >= _BYTES or i + 1 == batch.num_rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*made), [pa.int32(), pa.int64(), pa.int64(), pa.binary()])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], [id_col, "piece", "start", "length", "ids"])
                    rows, made, size = [], [], 0

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL("piece int, start long, length long, ids binary")])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset) that place all counted pieces, best fit first."""
    room: dict[int, list[list[int]]] = {}  # room left: ranges [first bin, bins]
    rooms: list[int] = []
    bins, runs = 0, []

    def leave(left: int, first: int, many: int) -> None:
        if left and many:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append([first, many])

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                space = rooms[at]
                first, many = room[space].pop()
                if not room[space]:
                    del room[space], rooms[at]
            else:  # as many new bins as the rest needs
                space, first = capacity, bins
                many = -(-todo // (capacity // length))
                bins += many
            each = min(space // length, todo)  # a bin stays the best fit until nothing more of this length fits
            used = min(many, todo // each)
            for j in range(each):
                runs.append((length, rank, rank + used, first, capacity - space + j * length))
                rank += used
            todo -= used * each
            leave(space - each * length, first, used)
            leave(space, first + used, many - used)
    return runs


def pack(pieces: DataFrame, key: list[str], capacity: int = 2048, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: gapless from 0 in each sequence of at most ``capacity``.

    ``key`` orders pieces of equal length; rows with equal keys are told apart arbitrarily but consistently.
    Lengths must be 1 to ``capacity``. An empty table stays empty. ``pieces`` is written once, as its counts
    and its rows must agree.
    """
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = stage(pieces.withColumn("_salt", F.pmod(F.xxhash64(*key, F.monotonically_increasing_id()), F.lit(salts)).cast("int")), "pieces")
    counted = stage(kept.groupBy(length, "_salt").agg(F.count("*").alias("_n")), "piece-counts")
    # at most `capacity` rows come to the driver
    counts = {r[0]: r[1] for r in counted.groupBy(length).agg(F.sum("_n")).collect()}
    runs = plan_runs(counts, capacity)
    plan = spark.createDataFrame(runs, "_length long, _lo long, _hi long, _first long, offset long")
    before = W.partitionBy(length).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    bases = stage(counted.select(length, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "piece-bases")
    place = F.row_number().over(W.partitionBy(length, "_salt").orderBy(*key)) - 1
    ranked = kept.withColumn("_place", place).join(bases, [length, "_salt"]).withColumn("_rank", F.col("_base") + F.col("_place"))
    slot = (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    # the plan's size follows the capacity, not the rows
    return ranked.join(F.broadcast(plan) if len(runs) <= PLAN_RUNS else plan, slot).select(
        *pieces.columns, (F.col("_first") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence, from packed pieces that still have their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
