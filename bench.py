"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8);
BENCH_QUERIES: comma list (default: the headline queries; "all" for every registered one).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from panelwright.plans.catalog import QUERIES  # noqa: E402
from panelwright.session import SETTINGS, scope  # noqa: E402

HEADLINE = [
    "form_report",
    "complete_panel",
    "side_context_join",
    "rolling_lagged",
    "ewm_lagged",
    "lag_last",
    "panel_features",
    "training_set",
    "opponent_strength",
    "upcoming_context",
    "adjust_predictions",
    "best_by_group",
    "validation_summary",
    "first_per_key",
    "unpivot_sides",
    "top_per_group",
    "column_stats",
    "ols_outliers",
    "ols_outliers_whole",
    "quadrants",
    "restrict_to",
    "round_half_even",
    "keyword_intent_documents",
    "route_messages",
    "chat_history",
    "build_prompts",
    "latest_partition",
    "csv_roundtrip",
    "incremental_refresh",
    "gbt_validation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", cpus)
        # the tables are small here: do not merge shuffle partitions below the number of cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one small query first, so that no query pays for starting the session
    QUERIES["entity_count"](spark, sf_dir).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        with scope(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
