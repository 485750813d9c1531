"""Near copies among embeddings: NN-descent towards all pairs above a cosine threshold.

Equal vectors become one. Neighbour lists start from several orders of the vectors by sign codes of random
projections: vectors that follow each other in an order are compared. Then neighbours of neighbours are joined
and compared until a round finds no new link. Only neighbours within twice the threshold's angle take part, as
two links over a common neighbour cannot be further apart. A vector whose list is full of links is saturated:
its list is enlarged to its whole component, compared in blocks of bounded size, from which only counts leave.
A sample of vectors outside such components is compared with all others to audit the recall, drawn until enough of
them have links; while the mean share of their links that was found is too low, more orders follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disarm.llm.components import components
from disarm.staging import stage

ORDERS = 16  # orders a round starts from
REACH = 10  # vectors that a vector is compared with in each order
NEIGHBOURS = 24  # length of a list before it is enlarged
ROUNDS = 8  # of neighbours' neighbours, and of further orders, at most
BLOCK = 512  # vectors of a saturated component compared at a time
AUDIT = 200  # vectors compared with all others at a time, for the audit
LINKED = 100  # of the audited vectors that must have links, unless there are fewer


def _unit(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # against overflow of squares
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _stack(vectors: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1)


def _packed(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for v in batch["v"]:
                x = None if v is None else np.array([math.nan if i is None else i for i in v], np.float64)
                fine = x is not None and len(x) and np.isfinite(x).all() and np.any(x)
                made.append(x.astype(kind).tobytes() if fine else None)
            yield pd.DataFrame({"row": batch["row"], "id": batch["id"], "vector": made})

    return run


def _codes(kind: str, first: int):
    """Each vector once per order, with its place in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["vector"].map(len)
            for bytes_in, part in batch.groupby(size):
                unit = _unit(_stack(part["vector"], kind))
                for order in range(first, first + ORDERS):
                    planes = np.random.default_rng([order, unit.shape[1]]).standard_normal((unit.shape[1], 48))
                    code = (unit @ planes > 0) @ (1 << np.arange(47, -1, -1))
                    yield pd.DataFrame({"size": bytes_in, "order": order, "code": code, "row": part["row"], "vector": part["vector"]})

    return run


def _adjacent(kind: str, floor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            fresh = 0 if held is None else len(held)
            rows = batch if held is None else pd.concat([held, batch])
            for (_, _), at in rows.reset_index(drop=True).groupby(["size", "order"]).indices.items():
                part = rows.iloc[at]
                unit, ids = _unit(_stack(part["vector"], kind)), part["row"].to_numpy()
                for k in range(1, min(REACH, len(part) - 1) + 1):
                    cosine = (unit[:-k] * unit[k:]).sum(axis=1)
                    keep = (cosine >= floor) & (at[k:] >= fresh)
                    if keep.any():
                        x, y = ids[:-k][keep], ids[k:][keep]
                        yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "cosine": cosine[keep]})
            held = rows.iloc[-REACH:]

    return run


def _compared(kind: str, floor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["va"].map(len) == batch["vb"].map(len)]
            for _, part in batch.groupby(batch["va"].map(len)):
                cosine = (_unit(_stack(part["va"], kind)) * _unit(_stack(part["vb"], kind))).sum(axis=1)
                yield pd.DataFrame({"a": part["a"], "b": part["b"], "cosine": cosine})[cosine >= floor]

    return run


def _block(kind: str, threshold: float):
    """Weighted links of the vectors of one block with those of another, or among themselves."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        unit, copies = _unit(_stack(group["vector"], kind)), group["copies"].to_numpy()
        left, right = (group["block"] == group["lo"]).to_numpy(), (group["block"] == group["hi"]).to_numpy()
        linked = unit[left] @ unit[right].T >= threshold
        ids = group["row"].to_numpy()
        if group["lo"].iloc[0] == group["hi"].iloc[0]:
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"row": ids[left], "links": linked @ copies[right]})
        return pd.DataFrame({
            "row": np.append(ids[left], ids[right]), "links": np.append(linked @ copies[right], copies[left] @ linked)})

    return run


def _audited(kind: str, threshold: float, sample: list[tuple[int, bytes]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = pd.DataFrame(sample, columns=["row", "vector"])
        for batch in batches:
            for size, part in batch.groupby(batch["vector"].map(len)):
                own = wanted[wanted["vector"].map(len) == size]
                if len(own):
                    cosine = _unit(_stack(own["vector"], kind)) @ _unit(_stack(part["vector"], kind)).T
                    i, j = np.nonzero((cosine >= threshold) & (own["row"].to_numpy()[:, None] != part["row"].to_numpy()[None, :]))
                    yield pd.DataFrame({"row": own["row"].to_numpy()[i], "other": part["row"].to_numpy()[j]})

    return run


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "cosine").unionByName(
        edges.select(F.col("b").alias("v"), F.col("a").alias("u"), "cosine"))


def _lists(edges: DataFrame) -> DataFrame:
    """The nearest neighbours of each vector; an order adds 2 * REACH to a list at most, so none is hot."""
    nearest = W.partitionBy("v").orderBy(F.desc("cosine"), "u")
    return _both(edges).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= NEIGHBOURS)


def near_copies(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.99
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept and audited_recall.

    Links are pairs with a cosine of at least ``threshold`` in double precision; each one kept was computed.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; nor do
    vectors of different lengths. component_id is the smallest id reachable by links, ``kept`` is true for the
    rows whose id that is. audited_recall is at least ``recall``, or an error is raised. Equal vectors count as links of each
    other, also under a repeated id. Null ids sort last and stay null. Other columns are ignored; an empty table gives an empty result.
    """
    kind = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    floor = math.cos(2 * math.acos(threshold))
    packed = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInPandas(
        _packed(kind), "row long, id long, vector binary")
    rows = stage(packed, "vectors")
    fine = rows.where("vector IS NOT NULL")
    classes = stage(fine.groupBy("vector").agg(F.min("row").alias("row"), F.count("*").alias("copies")), "vector-classes")
    a, b = [classes.select(F.col("row").alias(x), F.col("vector").alias(f"v{x}")) for x in "ab"]

    def audited(open_classes: DataFrame, links: DataFrame) -> float:
        """Mean share of found links, over vectors that have some, drawn by hash; 1.0 if none of all has one."""
        drawn = stage(open_classes.select("row", "vector").withColumn("turn", F.xxhash64("row")), "audit-order")
        after, size, linked, shares = None, AUDIT, 0, 0.0
        while linked < LINKED:
            left = drawn if after is None else drawn.where((F.col("turn") > after[0]) | ((F.col("turn") == after[0]) & (F.col("row") > after[1])))
            sample = left.orderBy("turn", "row").limit(size).collect()
            if not sample:
                break
            after = sample[-1]["turn"], sample[-1]["row"]
            found = classes.mapInPandas(_audited(kind, threshold, [(r["row"], bytes(r["vector"])) for r in sample]), "row long, other long")
            known = _both(links.withColumn("cosine", F.lit(1.0))).select(F.col("v").alias("row"), F.col("u").alias("other"), F.lit(1).alias("known"))
            each = found.join(known, ["row", "other"], "left").groupBy("row").agg(F.avg(F.coalesce("known", F.lit(0))).alias("share"))
            n, total = each.agg(F.count("*"), F.sum("share")).first()
            linked, shares, size = linked + n, shares + (total or 0.0), min(2 * size, 4 * AUDIT)
        return shares / linked if linked else 1.0

    def compared(pairs: DataFrame) -> DataFrame:
        return pairs.join(a, "a").join(b, "b").mapInPandas(_compared(kind, floor), "a long, b long, cosine double")

    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges, found_share = None, 1.0
    for again in range(ROUNDS):
        coded = classes.select("row", "vector").mapInPandas(_codes(kind, ORDERS * again), "size int, order int, code long, row long, vector binary")
        placed = coded.repartitionByRange(width, "order", "size", "code", "row").sortWithinPartitions("order", "size", "code", "row")
        start = placed.mapInPandas(_adjacent(kind, floor), "a long, b long, cosine double")
        edges = stage((start if edges is None else start.unionByName(edges)).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "edges")
        for _ in range(ROUNDS):
            lists = stage(_lists(edges), "lists")
            full = stage(lists.where(F.col("cosine") >= threshold).groupBy("v").count().where(f"count >= {NEIGHBOURS}").select("v"), "saturated")
            open_lists = lists.join(full, "v", "left_anti").select("v", "u")
            x, y = open_lists.withColumnRenamed("u", "a"), open_lists.withColumnRenamed("u", "b")
            pairs = x.join(y, "v").where("a < b").select("a", "b").distinct().join(edges, ["a", "b"], "left_anti")
            more = stage(compared(pairs), "more-edges")
            if more.where(F.col("cosine") >= threshold).isEmpty():
                break
            edges = stage(edges.unionByName(more), "edges")
        links = edges.where(F.col("cosine") >= threshold).select("a", "b")
        roots = stage(components(links), "roots")
        # inside a saturated component all pairs are compared, so the audit is of the vectors outside
        large = stage(roots.join(full.withColumnRenamed("v", "node"), "node").select("root").distinct(), "saturated-roots")
        inside = roots.join(large, "root", "left_semi")
        found_share = audited(classes.join(inside.select(F.col("node").alias("row")), "row", "left_anti"), links)
        if found_share >= recall:
            break
    else:
        raise RuntimeError(f"after {ROUNDS * ORDERS} orders the audited recall is {found_share:.4f}, below {recall}")

    weight = classes.select(F.col("row").alias("u"), "copies")
    listed = _both(links.withColumn("cosine", F.lit(1.0))).join(inside.select(F.col("node").alias("v")), "v", "left_anti").join(weight, "u")
    counted = listed.groupBy(F.col("v").alias("row")).agg(F.sum("copies").alias("links"))
    sizes = stage(inside.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "block-counts")
    member = inside.join(sizes, "root").withColumnRenamed("node", "row").join(classes, "row").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "row", "copies", "vector", F.octet_length("vector").alias("size"))
    blocks = dealt.groupBy("root", "size", "lo", "hi").applyInPandas(_block(kind, threshold), "row long, links long")
    n_links = stage(counted.unionByName(blocks.groupBy("row").agg(F.sum("links").alias("links"))), "link-counts")

    per_class = stage(classes.join(n_links, "row", "left").join(roots.withColumnRenamed("node", "row"), "row", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "row").alias("root")), "per-class")
    placed = stage(rows.join(per_class, "vector", "left").select("row", "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "row").alias("root")), "placed")
    lowest = stage(placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")), "lowest")
    return placed.join(lowest, "root").select(
        F.col("id").alias(id_col), "n_links", F.col("m.id").alias("component_id"), F.col("id").eqNullSafe(F.col("m.id")).alias("kept"),
        F.lit(found_share).alias("audited_recall"))
