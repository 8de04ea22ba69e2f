"""Times the headline queries: BENCH_SF_DIR (folder) and BENCH_CPUS (threads) choose the run.

Every query runs once on the smallest tables, so that code is compiled, and then BENCH_REPEATS times
(2) on the chosen ones; the fastest run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom import catalog
from barloom.session import build_session

HEADLINE = [
    "bars_1h", "bars_all_timeframes", "bar_gaps", "rolling_stats", "robust_z", "ewm_mean", "asof_features", "base_features",
    "rsi_signals", "rule_metrics", "candidate_scores", "barrier_events", "run_deltas", "range_alerts", "text_scrub", "page_text",
]
WARM = "/root/testdata/sf0.001"


def yardsticks(spark, folder: str, times: dict[str, float]) -> dict[str, float]:
    """What a query works through per second: bars made, feature rows, rule x bar pairs, barrier events."""
    from barloom.catalog.common import hourly, minutely
    from barloom.plans.rules import rule_grid

    counts = {
        "bars_all_timeframes": ("bars_per_s", lambda: catalog.QUERIES["bars_all_timeframes"](spark, folder).count()),
        "base_features": ("feature_rows_per_s", lambda: minutely(spark, folder).count()),
        "rule_metrics": ("rule_bars_per_s", lambda: hourly(spark, folder).count() * len(rule_grid("bollinger"))),
        "barrier_events": ("events_per_s", lambda: catalog.QUERIES["barrier_events"](spark, folder).count()),
    }
    return {name: round(count() / times[q], 1) for q, (name, count) in counts.items() if times.get(q)}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, repeats = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    names = sys.argv[1:] or HEADLINE
    spark.range(1).count()

    def run(name: str, at: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, at).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    for name in names:
        if os.path.isdir(WARM):
            run(name, WARM)
        times[name] = round(min(run(name, folder) for _ in range(max(1, repeats))), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")), "yardsticks": yardsticks(spark, folder, times)}))
    spark.stop()


if __name__ == "__main__":
    main()
