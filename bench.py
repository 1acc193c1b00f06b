"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query is run to the end
(every column of every row is computed) by a sink that discards the rows. The first run
of a query pays for code generation as well; the better of two runs is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "e3_remove_duplicates", "d1_exact_dedup", "a1_coverage_summary", "a4_merge_lists", "a14_market_density",
    "s4_csv_flattened", "s6_json_export", "x7_x8_phone_rating_in_documents", "x20_document_emails",
    "x16_detail_records", "x17_x19_page_names", "x26_x27_page_social", "x36_page_labels", "l1_w8_ranked_emails",
    "j1_upsert_overwrite", "j4_enrich_places", "j12_business_tags", "j14_change_log", "j8_competitors",
    "j3_similar_links", "c3_neighbour_pairs", "w3_trailing_requests", "w4_response_trend", "w5_failure_runs",
    "w7_rate_trace", "t9_failure_sessions", "a9_run_metrics", "x34_x35_quality", "t1_t3_stream_to_table",
    "export_lineitem_csv", "export_records_csv", "c1_clusters_wide", "c4_duplicate_groups",
]


def session(cpus: str) -> SparkSession:
    from listloom.session import RECOMMENDED_CONF

    b = SparkSession.builder.master(f"local[{cpus}]").appName("listloom-bench")
    conf = {
        **RECOMMENDED_CONF,
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def export_lineitem(spark, sf_dir):
    """Plain export speed: all line items as flattened CSV."""
    from listloom.session import work_path
    from listloom.sources.records import write_csv

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    write_csv(rows, work_path(spark, "bench-csv"))
    return rows.select("l_orderkey")


def export_records(spark, sf_dir):
    """Export speed of nested business records: flattened CSV."""
    from listloom.plans.views import businesses
    from listloom.session import work_path
    from listloom.sources.records import write_csv

    rows = businesses(spark, sf_dir)
    write_csv(rows, work_path(spark, "bench-csv"))
    return rows.select("seq")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    from listloom.plans.catalog import QUERIES as registered

    queries = {**registered, "export_lineitem_csv": export_lineitem, "export_records_csv": export_records}

    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of best query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
