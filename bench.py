"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "detect_type", "pdf_findings", "pdf_mask", "entry_name_rules", "zip_bomb", "archive_terminal", "markup_tokens",
    "markup_page_findings", "strip_markup", "image_segments", "inspect_verdicts", "archive_expand", "digest_dedupe",
    "files_processed", "duration_histogram", "error_streaks", "rate_limit_decisions", "token_redemption", "ledger_fold",
    "pin_acceptance", "split_chunks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("disarm-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("disarm.contentPartitions", cpus)  # the tables are single files of one row group
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from disarm.plans.catalog import QUERIES
    from disarm.staging import clear_staged

    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        clear_staged(spark)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
