"""Join helpers shared by the marts and the checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_join_sparse(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a key that is NULL for a large share of the left rows.

    NULL never matches, yet a shuffled join sends every such row to one task.
    Those rows get the hash of their whole content as a second key part, so there are
    as many groups as different rows; known keys get the same constant on both sides.
    """
    same = F.pmod(F.xxhash64(key), F.lit(1))
    own = F.xxhash64(*left.columns)
    spread_left = left.withColumn("_part", F.when(F.col(key).isNull(), own).otherwise(same))
    return spread_left.join(right.withColumn("_part", same), [key, "_part"], "left").select(
        *left.columns, *[c for c in right.columns if c != key]
    )


def left_join_known(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The same for a stored left side: rows without a key pass by the join.

    The join is on the key alone, so a right side that lies by the key stays where it is.
    """
    added = [c for c in right.columns if c != key]
    known = left.filter(F.col(key).isNotNull()).join(right, key, "left").select(*left.columns, *added)
    return known.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in the key set; rows are never multiplied."""
    return df.join(keys, list(on), "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the key set."""
    return df.join(keys, list(on), "left_anti")


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Append the columns of a one-row DataFrame to every row.

    A scalar subquery: the row is computed once and travels as a literal; more
    than one row fails the query.
    """
    packed = stats.select(F.struct(*stats.columns)).scalar()
    return df.withColumn("_s", packed).select(
        *df.columns, *[F.col("_s")[c].alias(c) for c in stats.columns]
    )


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Append aggregates over all rows to a table of a few groups, in one aggregation.

    The rows travel through it as one array, so use it only for tables that are small by
    meaning: one row per arm, type or day.
    """
    rows = F.collect_list(F.struct(*df.columns)).alias("_rows")
    packed = df.agg(rows, *[v.alias(k) for k, v in totals.items()])
    return packed.select(F.inline("_rows"), *totals)


def max_date(df: DataFrame, col: str, out: str = "max_date") -> DataFrame:
    """One row: the newest value of a column."""
    return df.agg(F.max(col).alias(out))


def densify(
    df: DataFrame,
    calendar: DataFrame,
    date_col: str,
    by: Sequence[str] = (),
    fill: Sequence[str] = (),
) -> DataFrame:
    """Every calendar day (per key) present; days without rows get zeros in ``fill``.

    ``df`` holds at most one row per key and day. The spine is each key's own
    copy of the calendar, so its size is the size of the answer.
    """
    days = calendar.select(F.col(date_col))
    if by:
        bounds = days.agg(F.sort_array(F.collect_set(date_col)).alias("d")).scalar()
        keys = df.select(*by).distinct()
        days = keys.withColumn(date_col, F.explode(bounds))
    spine = days.join(df, [*by, date_col], "left")
    return spine.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in fill})
