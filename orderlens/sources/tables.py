"""Written tables: mart scan, partitioned facts, late-data overwrite, metric sink."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.sources.swap import (
    discard,
    finish_swaps,
    partition_names,
    publish,
    staging_folder,
    swap_partitions,
)

METRIC_SCHEMA = (
    "section string, metric string, by string, value double, ci_lo double, ci_hi double, n bigint"
)

_DATED = re.compile(r"[^=/]+=\d{4}-\d\d-\d\d")


def read_mart(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write once, read back: what follows starts from stored rows.

    The table appears when it is complete; a run that fails leaves an earlier one in place.
    """
    return publish(df, path)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write once, dealt to buckets by a key and sorted by it inside them, and read back.

    Joins and groupings by the key of tables with as many buckets need no exchange. The
    buckets are known to the session's catalog; the files are plain parquet for others.
    The key must not be hot, as a bucket is one task.
    """
    spark = df.sparkSession
    name = f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay, and are overwritten
    writer = df.repartition(buckets, key).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def write_fact(
    df: DataFrame,
    path: str,
    partition_by: str,
    cluster_by: Sequence[str] = (),
    mode: str = "overwrite",
    whole_table: bool = True,
) -> None:
    """Date-partitioned fact, rows of a file ordered by the cluster columns.

    The rebalance hint lets the adaptive planner cut a heavy day into several
    tasks and join light days, so one busy date is not one writer.
    """
    laid_out = df.hint("rebalance", F.col(partition_by))
    laid_out = laid_out.sortWithinPartitions(partition_by, *cluster_by)
    writer = laid_out.write.mode(mode).partitionBy(partition_by)
    if not whole_table:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.option("partitionOverwriteMode", "static")
    writer.parquet(path)


def overwrite_lookback(
    df: DataFrame,
    path: str,
    date_col: str,
    days: int = 2,
    cluster_by: Sequence[str] = (),
    newest: date | None = None,
) -> tuple[date, date] | None:
    """Replace the partitions of the ``days`` dates up to ``newest``, and only those.

    Late rows land in recent dates. Older partitions are neither read nor written, and
    partitions after ``newest`` stay too, so a late or repeated run cannot undo a newer
    one; a date between that has no row any more is removed. Without ``newest`` it is the
    newest date of ``df``, all of which is then staged; with it, only the dates to replace
    are. ``df`` is evaluated once. Rows without a date fail the run before it changes
    anything. Returns the open start and the end of the range, None for nothing to do.
    """
    spark = df.sparkSession
    finish_swaps(spark, path)
    if newest is not None:
        df = df.filter(
            F.col(date_col).isNull()
            | ((F.col(date_col) > F.lit(newest - timedelta(days=days))) & (F.col(date_col) <= F.lit(newest)))
        )
    staged = staging_folder(path)
    write_fact(df, staged, date_col, cluster_by)
    found = partition_names(spark, staged)
    undated = [n for n in found if not _DATED.fullmatch(n)]
    if undated:
        raise ValueError(f"rows without a date in {date_col}: {undated}")
    if newest is None and not found:
        discard(spark, staged)
        return None
    newest = newest or date.fromisoformat(found[-1].split("=")[1])
    cut = newest - timedelta(days=days)

    def inside(name: str) -> bool:
        return bool(_DATED.fullmatch(name)) and str(cut) < name.split("=")[1] <= str(newest)

    replaced = [n for n in found if inside(n)]
    gone = [n for n in partition_names(spark, path) if inside(n) and n not in replaced]
    swap_partitions(spark, path, staged, replaced, gone)
    return cut, newest


def write_metrics(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Store the long metric table as JSON lines or parquet."""
    wanted = [f.split()[0] for f in METRIC_SCHEMA.split(",")]
    df.select(*wanted).write.mode("overwrite").format(fmt).save(path)


def read_metrics(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).format(fmt).load(path)
