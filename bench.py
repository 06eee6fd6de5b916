"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores;
names on the command line choose other queries, `all` every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallyhouse.plans.catalogue import QUERIES
from tallyhouse.session import local_session

HEADLINE = [
    "revenue_kpis",
    "kpi_headline",
    "revenue_by_category",
    "revenue_share",
    "monthly_revenue_12",
    "category_mom_growth",
    "product_performance",
    "daily_series",
    "series_profile",
    "promo_calendar",
    "training_frame",
    "fit_forecast",
    "forecast_points_per_pair",
    "parse_dates_coalesce",
    "coerce_numeric_vote",
    "dq_gate",
    "dq_report_index",
    "quality_log_build",
    "sink_curated_insert_ignore",
    "scd2_apply",
    "scd2_asof_lookup",
    "scan_workbooks",
    "bounded_context",
    "stream_incremental_ingest",
    "stream_daily_revenue",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(cpus)
    QUERIES["revenue_by_category"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total seconds of the queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
