"""Ranks over all rows or over large groups, without a task that holds a group.

Rows are range-partitioned by group and order into cells of about ``cell_rows`` rows and
stored with their cell. A window counts inside a cell; one small row for each cell carries
the counts of those before it. Where many rows share a value they are one row with a weight,
so a hot value is no hot cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.params import Params
from orderlens.session import keep

LIMITS = Params()


def cells(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], cell_rows: int
) -> DataFrame:
    """The rows with ``_cell``, which grows along ``by`` and ``order``, stored."""
    rows = keep(df)
    many = max(1, math.ceil(rows.count() / cell_rows))
    laid_out = rows.repartitionByRange(many, *by, *order)
    return keep(laid_out.withColumn("_cell", F.spark_partition_id()))


def borders(celled: DataFrame, by: Sequence[str], weight: Column) -> DataFrame:
    """One row per group and cell: its weight, the weight before it, the group's total."""
    sums = celled.groupBy(*by, "_cell").agg(F.sum(weight).alias("_inside"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *by,
        "_cell",
        "_inside",
        F.coalesce(F.sum("_inside").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_inside").over(group).alias("_total"),
    )


def beside(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """The rows beside their group's row of another table, NULL groups matching NULL.

    Without group columns the other table has one row.
    """
    other = groups.withColumnsRenamed({n: f"_of_{n}" for n in by})
    equal = [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in by]
    found = df.join(other, reduce(lambda a, b: a & b, equal, F.lit(True)), how)
    return found.drop(*[f"_of_{n}" for n in by])


def before(
    df: DataFrame,
    order: Sequence[Column | str],
    out: str,
    *,
    by: Sequence[str] = (),
    weight: str | None = None,
    total: str | None = None,
    cell_rows: int = LIMITS.cell_rows,
) -> DataFrame:
    """Add the count (or the weight) of the rows of a group that come before each row.

    ``order`` must be unique within a group. A group without columns is the whole table.
    """
    each = F.lit(1) if weight is None else F.col(weight)
    celled = cells(df, by, order, cell_rows)
    prior = Window.partitionBy(*by, "_cell").orderBy(*order)
    prior = prior.rowsBetween(Window.unboundedPreceding, -1)
    counted = celled.withColumn("_prior", F.coalesce(F.sum(each).over(prior), F.lit(0)))
    placed = beside(counted, borders(celled, by, each), [*by, "_cell"])
    added = {out: F.col("_start") + F.col("_prior")}
    if total:
        added[total] = F.col("_total")
    return placed.select(*df.columns, *[v.cast("bigint").alias(k) for k, v in added.items()])


def value_ranks(
    df: DataFrame,
    col: str,
    out: str,
    *,
    by: Sequence[str] = (),
    descending: bool = False,
    cell_rows: int = LIMITS.cell_rows,
) -> DataFrame:
    """by..., col, n, out, total: each distinct value with the rank of its first row.

    Ties share a rank; ``out + (n - 1) / 2`` is the mid-rank. Null values have no rank and
    no row.
    """
    values = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    order = F.col(col).desc() if descending else F.col(col).asc()
    ranked = before(values, [order], out, by=by, weight="n", total="total", cell_rows=cell_rows)
    return ranked.withColumn(out, F.col(out) + 1)


def with_rank(
    df: DataFrame,
    col: str,
    out: str,
    *,
    by: Sequence[str] = (),
    descending: bool = False,
    mid: bool = False,
    cell_rows: int = LIMITS.cell_rows,
) -> DataFrame:
    """Add the rank of a value in its group, ties sharing the first or the middle rank.

    A null value has a null rank. The join on the value is as skewed as the values are,
    which the adaptive planner splits.
    """
    ranks = value_ranks(df, col, "_rank", by=by, descending=descending, cell_rows=cell_rows)
    rank = F.col("_rank") + (F.col("n") - 1) / 2 if mid else F.col("_rank")
    other = ranks.select(*by, F.col(col).alias("_value"), rank.alias(out))
    placed = beside(df.withColumn("_value", F.col(col)), other, [*by, "_value"], "left")
    return placed.select(*df.columns, F.when(F.col(col).isNotNull(), F.col(out)).alias(out))
