"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, as
one line of JSON; ``--all`` times the whole catalog. Every query is run to its
last row without collecting it."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from daypanel.operators import profile
from daypanel.plans.catalog import QUERIES, panel
from daypanel.session import tune
from daypanel.sources import sinks

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# One or more per kind of operator; the rest of the catalog are variants.
HEADLINE = (
    "typed_cast", "cast_quarantine", "price_normalise", "flags_event", "intraday_features", "ready_base",
    "terminal_events", "daily_universe", "cross_section_ranks", "rolling_history", "dedup_core", "duplicate_summary",
    "duplicate_event_digest", "duplicate_difference_rate", "duplicate_rows_detail", "profile_core",
    "abnormal_examples", "missing_by_group", "value_counts", "numeric_summary", "histogram", "forward_leads",
    "label_delist_stress", "label_summary", "panel_label_join", "target_winsor", "target_zscore", "model_panel",
    "size_targeted_sample", "stage_row_counts",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("daypanel-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def finish(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def scan_per_variable(df) -> None:
    """The plain form of the profile: one scan per variable."""
    for c in df.columns:
        finish(df.agg(F.count("*"), F.count_if(F.col(c).isNull())))


def main() -> None:
    spark = session()
    finish(QUERIES["value_counts"](spark, SF_DIR))  # warm up
    names = QUERIES if "--all" in sys.argv[1:] else HEADLINE
    seconds = {name: timed(lambda q=QUERIES[name]: finish(q(spark, SF_DIR))) for name in names}
    stored = sinks.stored(panel(spark, SF_DIR), "bench-panel")
    comparison = {
        "profile": timed(lambda: finish(profile.profile(stored))),
        "scan_per_variable": timed(lambda: scan_per_variable(stored)),
    }
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "profile_comparison": comparison,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
