"""Wall-clock of the warehouse build and of the headline queries.

Prints one JSON line. ``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the
local cores. Every query result is written to a null sink, so all rows are
computed and none travel to the driver. The first query of a run pays for
starting the JVM's code paths; it is a warm-up and is reported as such.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from orderlens.plans.warehouse import MARTS
from orderlens.registry.queries import callables, context

HEADLINE = (
    "stage_orders",
    "dedup_events",
    "order_items_fact",
    "orders_fact",
    "customer_sequence",
    "customer_orders_fact",
    "sessions_fact",
    "scd2_price_asof",
    "mad_outliers",
    "threshold_sweep",
    "grain_summary",
    "grain_by_band",
    "fill_by_day",
    "effect_by_tenure",
    "effect_by_segment",
    "stratified_effect",
    "proxy_contrasts",
    "ranking_stability",
    "srm_counts_chi2",
    "itt_readout",
    "welch_t_events",
    "business_metrics",
    "densified_daily_orders",
    "quality_checks",
    "analysis_report",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = callables()

    warm_up = timed(lambda: run(queries["stage_orders"](spark, folder)))
    stored = context(spark, folder).stored
    build = {f"build_{name}": timed(lambda n=name: stored[n]) for name in MARTS}
    seconds = {
        name: timed(lambda n=name: run(queries[n](spark, folder))) for name in HEADLINE
    }
    after_build = seconds["quality_checks"] + seconds["analysis_report"]
    full_run = round(sum(build.values()) + after_build, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "warehouse build, checks and full analysis",
                "value": full_run,
                "unit": "sec",
                "queries": {**build, **seconds},
                "warm_up": warm_up,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
