"""Benchmark decontamination: a prefix-filtered set join between documents and windows of benchmark items.

A window occurs in a document only if all its shingles do, so its rarest shingle is a necessary one. One pass
over the documents finds the places of all benchmark shingles; their counts there give the order. Places of
necessary shingles give candidates, which length and position bounds thin out. What is left goes back to the
document, once, where the words are compared one by one. Everything is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm.staging import clear_staged, mark, stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles, 8 bytes each, up to which the benchmark's set is sent to every task; above, both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then the runs of digits, letters and anything beyond ASCII. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAPS), "")


def windows_of(items: DataFrame, size: int, shingle: int) -> DataFrame:
    """Distinct windows: wid, words, n, items (those that have it) and g, the words in its shingles."""
    listed = items.select(F.col("item_id"), words_of(F.col("text")).alias("w"))
    n = F.size("w")
    parts = F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.slice("w", i, size))).when(
        n > 0, F.array("w"))
    each = listed.select("item_id", F.explode(parts).alias("words"))
    return each.groupBy("words").agg(F.array_distinct(F.collect_list("item_id")).alias("items")).select(
        F.xxhash64("words").alias("wid"), "words", F.size("words").alias("n"), "items", F.least(F.size("words"), F.lit(shingle)).alias("g"))


def _hash(words: list[Column], g: int) -> Column:
    return F.xxhash64(F.lit(g), *words[:g])


def _shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """wid, n, offset (from 0) and token of each window's shingles."""
    def of(g: int) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.col("n") - g + 1),
            lambda i: F.struct((i - 1).alias("offset"), _hash([F.get("words", i - 1 + k) for k in range(g)], g).alias("token")))

    by_size = F.coalesce(*[F.when(F.col("g") == g, of(g)) for g in range(1, shingle + 1)])
    return windows.select("wid", "n", F.explode(by_size).alias("s")).select("wid", "n", "s.offset", "s.token")


def _key() -> Column:
    """Stands for all rows of equal id and text, so that repeated and missing ids do no harm."""
    return F.xxhash64("doc_id", "text")


def _places(docs: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """key, n_words, pos (from 1) and token wherever a document has one of ``tokens``."""
    width = max(sizes)
    listed = docs.select(_key().alias("key"), words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    shifted = [F.slice("w", k + 1, F.greatest(F.col("n_words"), F.lit(1))).alias(f"w{k}") for k in range(width)]
    each = listed.select("key", "n_words", F.posexplode(F.arrays_zip(*shifted)).alias("at", "s"))
    parts = [F.col(f"s.w{k}") for k in range(width)]
    found = F.array_compact(F.array(*[F.when(parts[g - 1].isNotNull(), _hash(parts, g)) for g in sizes]))
    if len(sizes) == 1:
        made = each.select("key", "n_words", (F.col("at") + 1).alias("pos"), _hash(parts, sizes[0]).alias("token"), parts[sizes[0] - 1].isNotNull().alias("whole")).where("whole").drop("whole")
    else:
        made = each.select("key", "n_words", (F.col("at") + 1).alias("pos"), F.explode(found).alias("token"))
    return made.join(tokens, "token", "left_semi")


def contamination(
    docs: DataFrame, items: DataFrame, size: int = 13, shingle: int = 3, parts_in: int = 20
) -> DataFrame:
    """``docs`` (with doc_id and text) and n_words, n_hit, n_items, items_sha256, contaminated and hits.

    A window is ``size`` consecutive words of an item, or all words of a shorter one; an item without words has
    none. A word inside any occurrence of a window is hit. ``contaminated``: ``n_hit > 0 and parts_in * n_hit >=
    n_words``. ``hits`` lists (start, n) of the occurrences, words counted from 1. Items that repeat an id count
    as one item; null ids of items are left out of n_items and the digest. Null texts have no words. Each row of
    ``docs`` is judged, repeated ones alike; empty tables of either kind are fine. Other columns of ``docs`` stay,
    but for those named like the six new ones, which are replaced.
    """
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits")
    kept = [c for c in docs.columns if c not in made]
    # the row itself is one value, so that no column of it can clash
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), "doc_id", "text")
    spark, since = docs.sparkSession, mark()
    windows = stage(windows_of(items, size, shingle), "windows")
    shingles = stage(_shingles_of(windows, shingle), "window-shingles")
    sizes = sorted(r[0] for r in windows.select("g").distinct().collect())  # at most `shingle` numbers
    wanted = stage(shingles.select("token").distinct(), "wanted")
    places = stage(_places(docs, F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, sizes or [1]), "places")

    counts = places.groupBy("token").agg(F.count("*").alias("c"))
    rarest = F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "token", "offset")).alias("first")
    needed = shingles.join(counts, "token", "left").groupBy("wid").agg(rarest).where("first.c > 0").select("wid", "first.token", "first.offset")
    prefix = stage(needed.join(windows, "wid").select("token", "offset", "n", "words", F.filter("items", lambda i: i.isNotNull()).alias("items")), "prefix-tokens")
    start = F.col("pos") - F.col("offset")
    bounds = (F.col("n") <= F.col("n_words")) & (start >= 1) & (start + F.col("n") - 1 <= F.col("n_words"))
    near = places.join(prefix, "token").where(bounds).groupBy("key").agg(
        F.collect_set(F.struct(start.alias("start"), "n", "words", "items")).alias("near"))
    until = mark()
    near = stage(near.withColumnRenamed("key", "_key"), "candidates")
    clear_staged(spark, since, until)  # the result reads the candidates only

    judged = docs.select("doc", _key().alias("_key"), words_of(F.col("text")).alias("w")).join(near, "_key", "left")
    holds = F.filter("near", lambda c: F.slice("w", c["start"], c["n"]) == c["words"])
    judged = judged.select("doc", F.size("w").cast("long").alias("n_words"), F.coalesce(holds, F.array().cast(near.schema["near"].dataType)).alias("holds"))
    covered = F.array_distinct(F.flatten(F.transform("holds", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))))
    named = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("holds", lambda c: c["items"])), lambda i: i.cast("string"))))
    judged = judged.withColumn("n_hit", F.size(covered).cast("long")).withColumn("found", named)
    return judged.select(
        "doc.*", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"),
        F.sha2(F.array_join("found", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (parts_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.transform("holds", lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"))).alias("hits"))
