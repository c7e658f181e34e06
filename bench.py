"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores. Every query is run to the
end with the `noop` sink, once to warm up and then BENCH_RUNS times (default 1); the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship", "e6_heuristic", "e7_rules", "e9_recurring", "e13_precedence", "c1_content_hash", "c9_usage_summary", "m2_learn",
    "m3_token_suggestions", "m5_vector_top_k", "q2_counts", "q5_statement_result", "q7_grid_totals", "q15_isolation", "x4_rollup", "x5_voucher_entries",
    "x7_mode_totals", "snk1_csv", "snk2_json", "snk3_voucher_xml", "p3_template_header", "p11_transactions", "p12_text_lines", "o2_cells", "o4_block_cells",
    "k4_failure_alerts", "k5_running_rate", "r1_mask", "r4_redact_log", "t5_latest_status", "v1_balance_check", "v5_warnings", "v8_stitched",
]


def main() -> None:
    from vouchline.plans import catalog
    from vouchline.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = int(os.environ.get("BENCH_CPUS", "8")), int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(f"local[{cpus}]", cpus, **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(min(once(name) for _ in range(runs)), 3)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus, "transactions": rows, "enrich_rows_per_sec": round(rows / seconds["e6_heuristic"]), "parse_rows_per_sec": round(rows / seconds["p11_transactions"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
