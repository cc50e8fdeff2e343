"""Headline timings on one machine: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from blockloom.catalog import all_queries  # noqa: E402
from blockloom.session import build_session  # noqa: E402

HEADLINE = [
    "extract_field", "filter_conjunction", "extract_conversation", "dedupe_prefix", "dry_run_stats", "tokenize_bytes",
    "tokenize_vocab", "pack_blocks", "blocks_per_source", "multi_dataset_pack", "write_block_shards", "manifest",
    "sample_blocks", "sample_windows", "bigram_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = all_queries(), {}
    for table in ("documents", "events", "conversations"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").agg(F.count("*")).collect()
    for name in HEADLINE:
        begin = time.perf_counter()
        # All rows are computed and their columns consumed; nothing is collected.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    totals = queries["sequence_estimate"](spark, sf_dir).first()
    chars = queries["dry_run_stats"](spark, sf_dir).first()
    print(json.dumps({
        "metric": "corpus preparation, sum of headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
        "documents_per_sec_extract": round(chars["n_docs"] / took["extract_field"]),
        "tokens_per_sec_pack": round(totals["total_tokens"] / took["pack_blocks"]),
        "tokens_per_sec_write": round(totals["total_tokens"] / took["write_block_shards"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
