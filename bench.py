"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads. Each
query runs once to warm up and then twice into the noop sink; the median counts.
``lines_per_s`` is the throughput of tokenize, mask and route over generated access-log lines.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from timberline import catalog  # noqa: E402
from timberline.functions import masking  # noqa: E402
from timberline.functions.formats import event_lines  # noqa: E402
from timberline.operators import mining  # noqa: E402
from timberline.shipping import ship  # noqa: E402

HEADLINE = [
    "tokenize_documents", "mask_documents", "mask_nginx", "pattern_topk", "captures_documents", "mine_documents_online", "mine_syslog_online", "template_registry", "redact_documents", "severity_syslog", "timestamps_nginx",
    "lateness", "lql_filter_text", "lql_sequence", "lql_correlate", "window_counts_dense", "ewma_baseline", "insight_pipeline", "ingest_syslog", "stream_mine",
]


def timed(make, rounds: int = 2) -> float:
    times = []
    for k in range(rounds + 1):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        if k:
            times.append(time.perf_counter() - began)
    return statistics.median(times)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    queries = {name: round(timed(lambda name=name: catalog.QUERIES[name](spark, sf_dir)), 3) for name in HEADLINE}

    # a million lines in memory, so that only tokenize, mask and route are timed
    n = 1_000_000
    events = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 997).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.lit("view").alias("event_type"))
    held = event_lines(events, "nginx").select("raw").repartition(int(cpus)).cache()
    held.count()
    seconds = timed(lambda: held.select(mining.routing_key(masking.masked(masking.tokens(F.col("raw"))), 5).alias("k")))
    print(json.dumps({"metric": "headline queries", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": os.path.basename(sf_dir.rstrip("/")), "lines_per_s": round(n / seconds), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
