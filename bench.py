"""Headline queries, timed end to end (plan, run, every output row produced). Prints one JSON line."""
from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from vacantia.plans import catalog  # noqa: E402

HEADLINES = [
    "score_postings", "gate_ladder", "tier_rank", "batch_collapse", "posting_upsert", "match_upsert", "dedup_totals",
    "salary_stated", "salary_cascade", "ttl_lookup", "verdict_gates", "failure_cutoff", "source_cap",
    "keyword_round_cap", "src_himalayas", "src_remoteok", "src_weworkremotely", "union_sources", "html_strip",
    "html_main_text", "digest_document", "ingest_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")  # one machine here; on a cluster a folder all executors see
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", shared)
        # no call-site bookkeeping for each of the many column expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    # one unmeasured query, so that no headline pays for starting the session
    catalog.QUERIES["gate_ladder"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "sightings": orders,
        "rows_per_sec": {n: round(orders / seconds[n]) for n in ("score_postings", "posting_upsert", "salary_cascade")},
    }))
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
