"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the table directory (default sf0.1), BENCH_CPUS the local cores.
Each query runs once, which counts as its first run (landing inputs where it is the first
to need them), and then BENCH_RUNS times; the best of these counts. The total is that of the
headline queries; the other queries that read lines are timed besides.
Results are fully computed and thrown away on the executors.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from profitloom.catalog import all_queries  # noqa: E402
from profitloom.session import build_session  # noqa: E402

HEADLINE = [
    "weekly_profit",
    "headline_totals",
    "net_result",
    "pnl_statement",
    "fee_breakdown",
    "year_forecast",
    "break_even",
    "unmatched_products",
    "weekly_aov",
    "daily_orders",
    "hour_pattern",
    "weekly_shipping",
    "top_products_profit",
    "product_margin",
    "repeat_customers",
    "payment_summary",
    "city_top",
    "discount_usage",
    "discount_profitability",
    "best_week",
    "best_customer",
    "unfulfilled_orders",
    "orders_summary",
    "line_detail",
    "line_items",
    "line_items_nested",
    "card_fees_by_order",
    "wallet_fee_summary",
    "incremental_orders",
    "streaming_daily_sales",
]

# Other queries that scan lines.
FURTHER = [
    "line_revenue",
    "vat_split",
    "cost_join",
    "line_profit",
    "active_lines",
    "order_fields",
    "orders_source",
    "order_level",
    "order_totals",
    "order_table",
    "txn_fee",
    "forecast_statement",
    "overall_fee_rate",
    "unmatched_headline",
    "best_sellers",
    "contribution_margin",
    "best_product",
    "best_day",
    "biggest_order",
    "cost_coverage",
    "reconciliation",
    "allocation_check",
    "sink_tables",
    "streaming_weekly_sales",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE + FURTHER
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times, first = {}, {}
    for name in chosen:
        run = lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        first[name] = round(timed(run), 3)
        best = min(timed(run) for _ in range(runs if name not in FURTHER else 1))
        times[name] = round(best, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times[n] for n in chosen if n not in FURTHER), 3),
                "unit": "sec",
                "queries": times,
                "first_run": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
