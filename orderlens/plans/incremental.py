"""Loads after the first: recent dates are replaced, and only the customers they touch.

The facts by date take the lookback overwrite. A customer's sequence depends on all of the
customer's orders, so it cannot be replaced by date. It is stored in parts by a hash of the
customer; a load compares the recent dates of the stored rows with the new ones, sequences
the customers that differ anew from what their part already holds, and swaps those parts.
The orders of other dates are never read again.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.operators.timeline import sequence
from orderlens.params import Params
from orderlens.session import keep
from orderlens.sources.swap import finish_swaps, partition_names, staging_folder, swap_partitions
from orderlens.sources.tables import write_fact

LIMITS = Params()
PARTS = 256


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _sequenced(orders: DataFrame, key: str, at: str, tie: str, parts: int, p: Params) -> DataFrame:
    placed = sequence(orders, key, at, tie, hot_rows=p.hot_rows, cell_rows=p.cell_rows)
    return placed.withColumn("part", _part(key, parts))


def store_sequence(
    orders: DataFrame,
    path: str,
    *,
    key: str = "customer_id",
    at: str = "ordered_at_gst",
    tie: str = "order_id",
    parts: int = PARTS,
    params: Params = LIMITS,
) -> None:
    """Write the whole sequence in ``parts`` parts by customer."""
    write_fact(_sequenced(orders, key, at, tie, parts, params), path, "part", [key, at, tie])


def read_sequence(df: DataFrame, path: str) -> DataFrame:
    """The stored sequence; ``df`` names the session and the order columns."""
    spark = df.sparkSession
    finish_swaps(spark, path)
    return spark.read.parquet(path)


def resequence(
    recent: DataFrame,
    path: str,
    date_col: str,
    cut: date,
    newest: date,
    *,
    key: str = "customer_id",
    at: str = "ordered_at_gst",
    tie: str = "order_id",
    parts: int = PARTS,
    params: Params = LIMITS,
) -> list[str]:
    """Bring a stored sequence up to date after the dates in (cut, newest] were replaced.

    ``recent`` has the new orders of those dates, all of them, with the columns the sequence
    was stored with. The result equals a rebuild. Returns the parts that were replaced: those
    of customers with an order that is new, gone or changed, an order that moved to another
    customer counting for both. ``parts`` must be that of the store.
    """
    names = recent.columns
    stored = read_sequence(recent, path)
    day = F.col(date_col)
    inside = (day > F.lit(cut)) & (day <= F.lit(newest))
    fresh = keep(recent.filter(inside))
    signed = stored.filter(inside).select(*names, F.lit(-1).alias("_sign")).unionByName(
        fresh.withColumn("_sign", F.lit(1))
    )
    different = signed.groupBy(*names).agg(F.sum("_sign").alias("_sign")).filter(F.col("_sign") != 0)
    changed = keep(different.select(F.col(key).alias("_key")).distinct())
    rows = changed.select(_part("_key", parts).alias("part")).distinct().collect()  # at most parts
    affected = sorted(r["part"] for r in rows)
    if not affected:
        return []

    def of_changed(df: DataFrame, how: str) -> DataFrame:
        return df.join(changed, F.col(key).eqNullSafe(F.col("_key")), how)

    old = stored.filter(F.col("part").isin(affected))
    earlier = of_changed(old, "left_semi").filter(~F.coalesce(inside, F.lit(False))).select(*names)
    orders = earlier.unionByName(of_changed(fresh, "left_semi"))
    redone = _sequenced(orders, key, at, tie, parts, params)
    same = of_changed(old, "left_anti").select(*redone.columns)
    staged = staging_folder(path)
    write_fact(same.unionByName(redone), staged, "part", [key, at, tie])
    replaced = partition_names(recent.sparkSession, staged)
    gone = [f"part={n}" for n in affected if f"part={n}" not in replaced]
    swap_partitions(recent.sparkSession, path, staged, replaced, gone)
    return replaced + gone
