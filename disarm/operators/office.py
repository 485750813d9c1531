"""Office packages: dangerous parts, external relationships and bombs, all within the file's own row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disarm import rules
from disarm.functions.names import base_name
from disarm.functions.zips import zip_parts, zip_rebuild
from disarm.operators.archive import is_rels, part_finding, path_finding, rels_finding
from disarm.operators.findings import finding, no_findings


def inspect_office(files: DataFrame) -> DataFrame:
    """``files`` (with ``listing`` and ``original_type``) → ``status, findings, error_message, output``.

    The listing is classified first, so only parts that survive are decompressed, and only
    relationship parts hand their bytes back.
    """
    dropped = F.transform(
        "listing",
        lambda e: F.struct(
            e["entry_idx"].alias("entry_idx"), e["name"].alias("name"),
            F.coalesce(path_finding(e["name"], office=True), part_finding(e["name"])).alias("f"),
        ),
    )
    rows = files.withColumn("_named", dropped)
    kept = F.filter("_named", lambda e: e["f"].isNull())
    rows = rows.withColumn(
        "_parts",
        zip_parts(
            F.when(F.col("listing").isNotNull(), F.col("content")),
            F.transform(kept, lambda e: e["entry_idx"]),
            F.transform(F.filter(kept, lambda e: is_rels(e["name"])), lambda e: e["entry_idx"]),
        ),
    )
    total = F.aggregate(
        "_parts", F.lit(0).cast("bigint"),
        lambda acc, p: acc + F.when(p["size"] <= rules.MAX_ENTRY_BYTES, p["size"]).otherwise(0),
    )
    # reading stops at the part that crosses the cap, so the last part read is the crossing one
    rows = rows.withColumn("_bomb_idx", F.when(total > rules.MAX_ARCHIVE_BYTES, F.element_at("_parts", -1)["entry_idx"]))

    def read_finding(part):
        name = F.get(F.col("listing"), part["entry_idx"])["name"]
        return (
            F.when(
                part["error"].isNotNull() | (part["size"] > rules.MAX_ENTRY_BYTES),
                finding("oversized_entry", base_name(name), "Entry skipped: exceeds size limit", "medium"),
            )
            .when(
                part["entry_idx"] == F.col("_bomb_idx"),
                finding(
                    "zip_bomb", name, f"cumulative decompressed size exceeds {rules.MAX_ARCHIVE_BYTES} bytes", "critical"
                ),
            )
            .otherwise(rels_finding(name, part["content"]))
        )

    hits = F.concat(
        F.transform(F.filter("_named", lambda e: e["f"].isNotNull()), lambda e: F.struct(e["entry_idx"].alias("i"), e["f"].alias("f"))),
        F.transform("_parts", lambda p: F.struct(p["entry_idx"].alias("i"), read_finding(p).alias("f"))),
    )
    hits = F.array_sort(
        F.filter(hits, lambda h: h["f"].isNotNull() & (F.col("_bomb_idx").isNull() | (h["i"] <= F.col("_bomb_idx"))))
    )
    rows = rows.withColumn("_hits", F.coalesce(hits, F.array().cast("array<struct<i: int, f: struct<type: string, location: string, description: string, severity: string>>>")))
    status = (
        F.when(F.col("listing").isNull(), "ERROR")
        .when(F.col("_bomb_idx").isNotNull(), "BLOCKED")
        .when(F.size("_hits") == 0, "CLEAN")
        .otherwise("SANITIZED")
    )
    rows = rows.withColumn("status", status)
    rebuilt = zip_rebuild(
        F.when(F.col("status") == "SANITIZED", F.col("content")),
        F.transform("_hits", lambda h: h["i"]),
        F.lit(None).cast("array<int>"),
        F.lit(None).cast("array<binary>"),
    )
    return rows.select(
        *[c for c in files.columns if c != "listing"],
        "status",
        F.coalesce(F.transform("_hits", lambda h: h["f"]), no_findings()).alias("findings"),
        F.when(F.col("status") == "ERROR", "office sanitize: invalid zip")
        .when(F.col("status") == "BLOCKED", "office sanitize: cumulative decompressed size exceeds limit")
        .alias("error_message"),
        F.when(F.col("status") == "CLEAN", F.col("content")).otherwise(rebuilt).alias("output"),
    )
