"""Time the registered queries: one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` an optional comma-separated
selection. ``BENCH_DUCKDB=1`` also times the equivalent SQL in DuckDB on four threads (key ``duckdb``). Each time is the best
of two runs after a warm-up query, from building the DataFrame to the last row written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES  # noqa: E402
from checks.compare import connect, local_session  # noqa: E402
from checks.oracle import ORACLE  # noqa: E402

HEADLINE = """monthly_trend daily_trend revenue_distribution top_customers top_products basket_summary price_histogram
category_funnel category_mix brand_mix category_monthly_funnel opportunity_summary rfm_customer rfm_segment_summary
stat_tests_summary mwu_month ztest_conversion price_box_by_month cohort_retention repeat_summary monthly_repeat_mix
cart_overview cart_by_category cart_by_price_band audit_combined audit_missing approx_distinct_kmv""".split()


def best_of(runs: int, work) -> float:
    times = []
    for _ in range(runs):
        started = time.perf_counter()
        work()
        times.append(time.perf_counter() - started)
    return round(min(times), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus)

    def run(name: str) -> None:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    run("monthly_trend")
    queries = {name: best_of(2, lambda: run(name)) for name in names}
    line = {
        "metric": "total_query_time",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    if os.environ.get("BENCH_DUCKDB"):
        con = connect(folder, threads=4)
        line["duckdb"] = {n: best_of(2, lambda: con.execute(ORACLE[n]).fetchall()) for n in names if n in ORACLE}
        line["duckdb_value"] = round(sum(line["duckdb"].values()), 3)
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
