"""``python -m orderlens SOURCE TARGET``: run everything from a folder of CSV sources."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from orderlens.params import Params
from orderlens.plans.run import run_all


def main() -> None:
    parser = argparse.ArgumentParser(prog="orderlens", description=__doc__)
    parser.add_argument("source", help="folder with the eight source files as CSV")
    parser.add_argument("target", help="folder for raw tables, marts, checks and metrics")
    parser.add_argument("--tz", default=Params.reporting_tz)
    parser.add_argument("--window-days", type=int, default=Params.retention_window_days)
    parser.add_argument("--mad-k", type=float, default=Params.mad_k)
    parser.add_argument(
        "--partition-by-date", action="store_true", help="lay the facts out by date"
    )
    parser.add_argument("--calendar-start", help="first day; the first order date if left out")
    parser.add_argument("--calendar-end", help="day after the last; from the orders if left out")
    args = parser.parse_args()
    params = Params(
        reporting_tz=args.tz,
        retention_window_days=args.window_days,
        mad_k=args.mad_k,
        calendar_start=args.calendar_start,
        calendar_end=args.calendar_end,
    )
    spark = SparkSession.builder.appName("orderlens").getOrCreate()
    run_all(spark, args.source, args.target, params, args.partition_by_date)
    spark.stop()


if __name__ == "__main__":
    main()
