"""N-gram Jaccard join: links between texts whose shingle sets overlap enough, found by prefix filters.

Any order of all tokens gives a filter: two sets that are similar enough share a token among the first
few of each. Several orders give several filters, and a pair must pass them all before it is verified.
All orders here put rare tokens first and differ in how they break ties and how finely they tell counts.

1. One pass over the texts deals out hashed shingles by hash, as packed arrays, with the rows they are from.
2. There each token's document count is known. Tokens of a single document go no further; the others return
   to their document. A document that shares too few tokens with any others is done: it has no link.
3. Equal sets become one. For the rest, the postings of prefix tokens under the first order give candidates.
   A list of postings is not paired out: each member meets one leader of its list, what links is contracted to
   components, and where a list still has several of them another leader follows, up to LEADERS rounds. The first
   leader is the member whose tokens the most documents have: the original of a group of near copies, or close to it.
   Only pairs that are in different components then meet one by one. So a group of copies costs a few checks a
   member.
4. Candidates are narrow pairs of rows. They are intersected with the pairs that share prefix tokens, at allowed
   positions, under each of the other orders; only then sets are fetched, of the rows left, and overlaps counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm.llm.components import components
from disarm.llm.shingles import shingle_sets
from disarm.staging import clear_staged, mark, stage

_U = np.uint64
_TOKEN = _U((1 << 48) - 1)  # low 48 bits: token; high 16: its document count, as far as that goes
LEADERS = 2  # rounds in which the members of a list meet one of them, before those still apart meet one by one
_FLUSH = 1_000_000  # tokens gathered in a task before they are dealt out
#: What the bucket that answers for a row is told of it.
_ROW = np.dtype([("row", "<i8"), ("id", "<i8"), ("null", "?"), ("key", "<i8"), ("key2", "<i8"), ("n", "<u4")])
BUCKET_BYTES = 8 << 20  # of input files that a bucket of tokens stands for, at most
IDS = 4_000_000  # rows whose sets are wanted, up to which their numbers go to all tasks (8 bytes each)
_SALTS = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))


def _pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _dealt(buckets: int, words: int):
    """Texts to packed tokens by bucket; each row is also told to one bucket that answers for it."""

    def flush(held: list[tuple], sets: list[np.ndarray]) -> pa.RecordBatch:
        told = np.array(held, _ROW)
        of = np.repeat(np.arange(len(sets)), told["n"])
        tokens = np.concatenate(sets)
        to = (tokens % _U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        answers = told["row"] % buckets
        made: list[tuple] = []
        for b in range(buckets):
            part = order[cuts[b]:cuts[b + 1]]
            mine = told[answers == b]
            if len(part) or len(mine):
                docs, counts = np.unique(of[part], return_counts=True)
                made.append((b, _pack(tokens[part]), told["row"][docs].tobytes(), counts.astype("<u4").tobytes(), mine.tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*made), [pa.int32(), *[pa.binary()] * 4])], ["bucket", "tokens", "rows", "counts", "told"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets, count = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = shingle_sets(part.column(4), words)
                held += [(r, i or 0, i is None, k, k2, len(f)) for r, i, k, k2, f in zip(*[part.column(c).to_pylist() for c in range(4)], found)]
                sets += found
                count += sum(map(len, found))
                if count >= _FLUSH:
                    yield flush(held, sets)
                    held, sets, count = [], [], 0
        if held:
            yield flush(held, sets)

    return run


def _counted(buckets: int):
    """The tokens of one bucket: those of two documents or more, with their counts, by the bucket of the document."""

    def run(dealt: pd.DataFrame) -> pd.DataFrame:
        tokens = _unpack(b"".join(dealt["tokens"]))
        join = lambda c, t: np.frombuffer(b"".join(dealt[c]), t)
        counts = join("counts", "<u4")
        rows = np.repeat(join("rows", "<i8"), counts)
        order = np.argsort(tokens, kind="stable")
        tokens, rows = tokens[order], rows[order]
        new = np.append(True, tokens[1:] != tokens[:-1]) if len(tokens) else np.empty(0, bool)
        of = np.cumsum(new) - 1
        df = np.bincount(of)[of] if len(of) else of
        shared = df >= 2
        weighted = tokens[shared] | (np.minimum(df[shared], 65535).astype(_U) << _U(48))
        rows = rows[shared]
        told = join("told", _ROW)
        to, answers = rows % buckets, told["row"] % buckets
        order = np.lexsort((rows, to))
        weighted, rows, to = weighted[order], rows[order], to[order]
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        made = []
        for b in range(buckets):
            a, z, mine = cuts[b], cuts[b + 1], told[answers == b]
            if z > a or len(mine):
                made.append((b, weighted[a:z].tobytes(), rows[a:z].tobytes(), mine.tobytes()))
        return pd.DataFrame(made, columns=["home", "tokens", "rows", "told"])

    return run


def _regrouped(need: float):
    """Per document its set's size and, if enough of the set is shared, its shared tokens in the first order."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        join = lambda c, t: np.frombuffer(b"".join(parts[c]), t)
        rows, tokens = join("rows", "<i8"), join("tokens", "<u8")
        order = np.lexsort((tokens, rows))
        rows, tokens = rows[order], tokens[order]
        told = join("told", _ROW)
        first, last = np.searchsorted(rows, told["row"]), np.searchsorted(rows, told["row"], "right")
        return pd.DataFrame({
            "row": told["row"], "id": pd.array(told["id"], "Int64"), "key": told["key"], "key2": told["key2"], "n": told["n"].astype(np.int64),
            "tokens": [tokens[a:z].tobytes() if n and z - a >= need * n else None for a, z, n in zip(first, last, told["n"].tolist())],
        }).assign(id=lambda d: d["id"].mask(told["null"]))

    return run


def _prefix(n: int, num: int, den: int) -> int:
    """So many first tokens, of any order, must meet the first tokens of a similar set."""
    return n - -(-n * num // den) + 1


def _ordered(tokens: np.ndarray, kind: int) -> np.ndarray:
    """The same tokens under one of three global orders; they come in the first one."""
    if kind == 0:
        return tokens
    df, token = tokens >> _U(48), tokens & _TOKEN
    if kind == 1:
        return tokens[np.lexsort((token * _SALTS[0], df))]
    return tokens[np.lexsort((token * _SALTS[1], np.log2(np.maximum(df, 1).astype(np.float64)).astype(np.int64)))]


_POSTING = "kind int, token long, row long, place int, n int, common float"


def _postings(num: int, den: int, kinds: tuple[int, ...]):
    """Prefix tokens of each set under some orders, with the place of the token and how common the set's tokens are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: dict[str, list] = {c: [] for c in ("kind", "token", "row", "place", "n", "common")}
            for r, n, data in zip(batch["row"], batch["n"], batch["tokens"]):
                tokens = np.frombuffer(data, "<u8")
                alone = n - len(tokens)  # tokens of this document only come first and meet nothing
                take = min(len(tokens), max(0, _prefix(n, num, den) - alone))
                common = int((tokens >> _U(48)).sum()) / n
                for kind in kinds:
                    made["token"].append(_ordered(tokens, kind)[:take].view(np.int64))
                    made["place"].append(np.arange(alone, alone + take))
                    for column, value in (("kind", kind), ("row", r), ("n", n), ("common", common)):
                        made[column].append(np.full(take, value))
            if made["token"]:
                yield pd.DataFrame({c: np.concatenate(v) for c, v in made.items()})

    return run


def _verified(num: int, den: int):
    """Pairs whose overlap, counted exactly, is enough."""

    def similar(n: int, a: np.ndarray, m: int, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return den * both >= num * (n + m - both)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similar(n, np.frombuffer(x, "<u8"), m, np.frombuffer(y, "<u8")) for n, x, m, y in zip(batch["n_a"], batch["tokens_a"], batch["n_b"], batch["tokens_b"])]
            yield batch.loc[keep, ["a", "b"]]

    return run


def _fits(num: int, den: int) -> Column:
    """Whether postings ``l`` and ``r`` may be of a similar pair: they have the same token where length and position allow it."""
    n, m = F.col("l.n").cast("long"), F.col("r.n").cast("long")
    rest = F.least(n - F.col("l.place"), m - F.col("r.place"))
    return (
        (F.col("l.token") == F.col("r.token"))
        & (den * F.least(n, m) >= num * F.greatest(n, m))
        & ((num + den) * rest >= num * (n + m)))


def _paired(met: DataFrame) -> DataFrame:
    """Distinct pairs of rows of joined postings."""
    return met.select(F.least("l.row", "r.row").alias("a"), F.greatest("l.row", "r.row").alias("b")).distinct()


def _also_under(pairs: DataFrame, postings: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs that share prefix tokens under the order of ``postings`` too."""
    left = pairs.join(postings, F.col("a") == F.col("row")).select("a", "b", F.struct("token", "place", "n").alias("l"))
    return left.join(postings.alias("r"), (F.col("b") == F.col("r.row")) & _fits(num, den)).select("a", "b").distinct()


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell rows apart by id and text, also where ids repeat or are missing."""
    return F.concat(*[F.lpad(F.hex(h), 16, "0") for h in _halves(doc_id, text)])


def _halves(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(doc_id.cast("long"), text), F.xxhash64(F.lit("row"), text, doc_id.cast("long"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept and key, which :func:`row_key` gives.

    Rows link when ``100 * |A and B| >= percent * |A or B|`` for their sets of shingles; component_id is the
    smallest id reachable by links, the row's own included, and ``kept`` is true for one row of a component
    (of the smallest id). Null and empty texts have an empty set and no link. Equal sets are linked, also
    those of rows that repeat an id; each row counts. A null id is larger than any other and stays null.
    Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    spark, num, den, since = docs.sparkSession, percent, 100, mark()
    key, key2 = _halves(F.col(id_col), F.col(text_col))
    rows = _sets(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), key.alias("key"), key2.alias("key2"), F.col(text_col).alias("text")), words, num / den)
    sets = rows.where("tokens IS NOT NULL").select("row", "n", "tokens")
    # a set that equals another one has all its tokens shared, so the others are told apart without looking at them
    equal = sets.where(F.length("tokens") == 8 * F.col("n")).select("row", F.concat(F.col("n").cast("string"), F.lit("-"), F.md5("tokens")).alias("class"))
    # what is grouped by a key is written before it meets the rows of that key, so that Spark can split hot keys of the join
    classes = stage(equal.groupBy("class").agg(F.min("row").alias("first"), F.count("*").alias("many")).where("many > 1").select("class", "first"), "set-classes")
    copies = stage(equal.join(classes, "class").where("row <> first").select("row", "first"), "set-copies")
    gone = copies.select("row")
    reps = stage(sets.join(F.broadcast(gone) if copies.count() <= IDS else gone, "row", "left_anti"), "set-reps")
    placed = stage(reps.mapInPandas(_postings(num, den, (0,)), _POSTING).drop("kind").withColumn("root", F.col("row")), "postings")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among candidates: the other orders thin them out, then overlaps are counted."""
        pairs = stage(pairs, "candidates")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        few = 2 * pairs.count() <= IDS
        fetched = stage(reps.join(F.broadcast(wanted) if few else wanted, "row", "left_semi"), "fetched")
        others = stage(fetched.mapInPandas(_postings(num, den, (1, 2)), _POSTING).drop("common"), "other-postings", "kind")
        for kind in (1, 2):
            pairs = _also_under(pairs, others.where(F.col("kind") == kind).drop("kind"), num, den)
        a, b = (fetched.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
        return stage(pairs.join(b, "b").join(a, "a").mapInPandas(_verified(num, den), "a long, b long"), "links")

    # one leader in a list, another one next time, while that finds links; then whatever is still apart, one by one
    links = None
    fits = _fits(num, den) & (F.col("l.root") != F.col("r.root"))
    for turn in range(LEADERS + 1):
        rank = F.struct("common", "row") if turn == 0 else F.struct(F.xxhash64("row", F.lit(turn)))
        lists = stage(placed.groupBy("token").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by(F.struct("token", "row", "root", "place", "n"), rank).alias("r")).where("lo < hi").select("token", "r"), "lists")
        if lists.isEmpty():  # nothing is left to meet
            break
        # a list in one component stays so, and is done with
        met = stage(placed.join(lists, "token"), "mixed-postings")
        placed = met.drop("r")
        led = met.select(F.struct("token", "row", "root", "place", "n").alias("l"), "r")
        found = verified(_paired(led.where(fits))) if turn < LEADERS else None
        last = found is None or found.isEmpty()
        if last:
            found = verified(_paired(placed.alias("l").join(placed.alias("r"), fits)))
        links = found if links is None else links.unionByName(found)
        if last:
            break
        placed = stage(_with_root(placed.drop("root"), links), "placed-postings")
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    placed = _with_root(rows.select("row", "id", "key", "key2", "n"), links.unionByName(copies.select(F.col("row").alias("a"), F.col("first").alias("b"))))
    until = mark()
    placed = stage(placed, "placed")
    clear_staged(spark, since, until)  # the result reads no more than is staged from here on
    lowest = stage(placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")), "lowest")
    return placed.join(lowest, "root").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("m.id").alias("component_id"), (F.col("m.row") == F.col("row")).alias("kept"),
        F.concat(F.lpad(F.hex("key"), 16, "0"), F.lpad(F.hex("key2"), 16, "0")).alias("key"))


def _with_root(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the component of each under ``links``; a row without a link is its own."""
    return rows.join(components(links).withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))


def _sets(rows: DataFrame, words: int, need: float) -> DataFrame:
    """row, id, n and the tokens that may link, from one pass over the texts, staged."""
    # a bucket is worked on as a whole, so there are as many as keep one small
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = least if size > 1 << 60 else max(least, -(-size // BUCKET_BYTES))  # Spark's guess where it doesn't know is above that
    dealt = rows.mapInArrow(_dealt(buckets, words), "bucket int, tokens binary, rows binary, counts binary, told binary")
    counted = dealt.groupBy("bucket").applyInPandas(_counted(buckets), "home int, tokens binary, rows binary, told binary")
    return stage(counted.groupBy("home").applyInPandas(_regrouped(need), "row long, id long, key long, key2 long, n long, tokens binary"), "sets")
