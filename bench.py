"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_ONLY (comma-separated name parts, optional).
Each query is computed in full and written to the no-op sink, so nothing is pruned away and nothing reaches the driver.
"""

from __future__ import annotations

import json
import os
import time

from trapline.operators import trends
from trapline.plans import all_queries
from trapline.plans.registry import runner
from trapline.plans.statistics_queries import scopes, stored_activity
from trapline.session import build_session
from trapline.sources.starschema import Survey

HEADLINE = (
    "a8_top_species",
    "c1_ranked_consensus",
    "c3_quorum_decision",
    "g1_sessionise",
    "g3_location_sessions",
    "a3_monthly_activity",
    "a4_total_effort",
    "a7_location_stats",
    "a10_dashboard_kpis",
    "a12_contributor_stats",
    "a26_coverage_calendar",
    "a29_deployment_photo_counts",
    "f6_qc_exclusion",
    "f20_series_positions",
    "x4_human_ai_records",
    "x6_independent_events",
    "t6_smooth_curve_rai",
    "t7_curve_band_smooth",
    "t9_overlap_matrix",
    "t13_diversity",
    "m2_merged_predictions",
    "m3_series_labels",
    "m6_merged_register",
    "q8_archivable_series",
    "w1_remaining_series",
    "p1_pending_by_species",
)


def full_trends(survey: Survey):
    """Trends and tests with the full 10,000 iterations."""
    facts = stored_activity(survey)
    yearly = trends.yearly_trend(trends.yearly_sums(facts), scopes(survey, facts), 10_000)
    return trends.trend_test(yearly)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    spark = build_session("trapline-bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    jobs = {name: runner(known[name]) for name in HEADLINE}
    jobs["t1_t3_trends_10000"] = lambda session, path: full_trends(Survey(session, path))
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):  # start the workers and compile the common code once, outside the clock
        jobs["a8_top_species"](spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, job in jobs.items():
        if only and not any(p in name for p in only):
            continue
        start = time.perf_counter()
        job(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
