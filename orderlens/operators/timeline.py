"""Ordered per-key columns that survive a hot key.

A plain window sends every row of a key to one task. Here the keys with more than
``hot_rows`` rows are found by an exact count first; if there are none, the plain
window runs over everything. Otherwise only the rows of those keys are cut: they are
range-partitioned by the key and the whole order, including the tie-breaker, into cells
of about ``cell_rows`` rows. The edges are quantiles of the rows themselves, so a batch
stamped with one instant among ordinary rows is cut as evenly as any other stretch.

The rows are stored together with their cell, once, so that the windows per (key, cell)
and the one small row per cell that carries counts and border rows across see the same
cells, also when a task runs again. The result equals the plain window. Rows of the other
keys take the plain window; hot keys and carries are joined without a hint.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.columns import days_between
from orderlens.session import keep


def _same(names: Sequence[str], prefix: str) -> Column:
    """Equality of each column with its prefixed copy, NULL matching NULL."""
    equal = [F.col(n).eqNullSafe(F.col(f"{prefix}{n}")) for n in names]
    return reduce(lambda a, b: a & b, equal)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """keys..., _n: the keys with more than ``hot_rows`` rows, stored."""
    return keep(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows))


def stored_cells(
    df: DataFrame, hot: DataFrame, keys: Sequence[str], order: Sequence[str], cell_rows: int
) -> DataFrame:
    """The rows of the hot keys with ``_cell``, which grows along key and order."""
    listed = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    rows = df.join(listed, _same(keys, "_hot_"), "left_semi")
    cells = hot.agg(F.ceil(F.sum("_n") / cell_rows).cast("int")).first()[0]
    return keep(
        rows.repartitionByRange(cells, *keys, *order).withColumn("_cell", F.spark_partition_id())
    )


def hot_limit(counts: DataFrame, column: str, hot_rows: int | None) -> int | None:
    """The limit, or None where no key of a stored count table is above it.

    The filter reaches the scan, whose file statistics usually answer it.
    """
    if hot_rows is None or counts.filter(F.col(column) > hot_rows).isEmpty():
        return None
    return hot_rows


def ordered_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    row_number: str | None = None,
    total: str | None = None,
    lead: Mapping[str, str] | None = None,
    lag: Mapping[str, str] | None = None,
    max_before: Mapping[str, str] | None = None,
    hot_rows: int | None,
    cell_rows: int,
) -> DataFrame:
    """Add row number, key total, next, previous and running maximum of prior rows.

    ``order`` must be unique within a key. ``lead``, ``lag`` and ``max_before`` map new
    names to columns. Without ``hot_rows`` every key stays whole and nothing runs here;
    with it the rows per key are counted at once, and only hot keys are cut and stored.
    """
    lead, lag, max_before = dict(lead or {}), dict(lag or {}), dict(max_before or {})
    columns = (row_number, total, lead, lag, max_before)
    hot = None if hot_rows is None else hot_keys(df, keys, hot_rows)
    if hot is None or hot.isEmpty():
        return _windows(df, keys, order, *columns, None).select(*df.columns, *_names(*columns))
    listed = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    others = df.join(listed, _same(keys, "_hot_"), "left_anti")
    celled = stored_cells(df, hot, keys, order, cell_rows)
    carry = _carry(celled, keys, order, lead, lag, max_before)
    parts = [
        _windows(others, keys, order, *columns, None),
        _windows(celled, keys, order, *columns, carry),
    ]
    return reduce(DataFrame.unionByName, [p.select(*df.columns, *_names(*columns)) for p in parts])


def _names(
    row_number: str | None,
    total: str | None,
    lead: Mapping[str, str],
    lag: Mapping[str, str],
    max_before: Mapping[str, str],
) -> list[str]:
    return [n for n in (row_number, total) if n] + [*lead, *lag, *max_before]


def _windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    row_number: str | None,
    total: str | None,
    lead: Mapping[str, str],
    lag: Mapping[str, str],
    max_before: Mapping[str, str],
    carry: DataFrame | None,
) -> DataFrame:
    """The new columns by windows per key, or per cell with what ``carry`` adds to them."""
    group = list(keys) if carry is None else [*keys, "_cell"]
    sequence = Window.partitionBy(*group).orderBy(*order)
    prior = sequence.rowsBetween(Window.unboundedPreceding, -1)
    inside = {f"_next_{out}": F.lead(c).over(sequence) for out, c in lead.items()}
    inside |= {f"_prev_{out}": F.lag(c).over(sequence) for out, c in lag.items()}
    inside |= {f"_top_{out}": F.max(c).over(prior) for out, c in max_before.items()}
    if row_number or lag:
        inside["_seq"] = F.row_number().over(sequence).cast("bigint")
    if lead and carry is not None:
        inside["_has_next"] = F.lead(F.lit(True)).over(sequence)
    if total:
        inside["_n"] = F.count(F.lit(1)).over(Window.partitionBy(*group))
    rows = df.withColumns(inside)

    added = {}
    if row_number:
        added[row_number] = F.col("_seq")
    if total:
        added[total] = F.col("_n")
    added |= {out: F.col(f"_next_{out}") for out in lead}
    added |= {out: F.col(f"_prev_{out}") for out in lag}
    added |= {out: F.col(f"_top_{out}") for out in max_before}
    if carry is not None:
        other = carry.withColumnsRenamed({n: f"_right_{n}" for n in group})
        rows = rows.join(other, _same(group, "_right_"), "left")
        if row_number:
            added[row_number] += F.coalesce("_c_before", F.lit(0))
        if total:
            added[total] = F.coalesce("_c_total", "_n")
        for out in lead:
            own = F.when(F.col("_has_next"), added[out])
            added[out] = own.otherwise(F.col(f"_c_{out}"))
        for out in lag:
            own = F.when(F.col("_seq") > 1, added[out])
            added[out] = own.otherwise(F.col(f"_c_{out}"))
        for out in max_before:
            added[out] = F.greatest(added[out], F.col(f"_c_{out}"))
    return rows.select(*df.columns, *[v.alias(k) for k, v in added.items()])


def _carry(
    celled: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lead: Mapping[str, str],
    lag: Mapping[str, str],
    max_before: Mapping[str, str],
) -> DataFrame:
    """What each cell of a hot key needs from its neighbours: one row per cell.

    The first value of the leading order column is its minimum, a fixed-width
    aggregate; other columns travel in a row compared by the whole order.
    """
    rank = [F.col(c) for c in order]

    def edge(c: str, pick: Callable[[Column], Column]) -> Column:
        if c == order[0]:
            return pick(F.col(c))
        return pick(F.struct(*rank, F.col(c).alias("_v")))["_v"]

    found = {"_c_n": F.count(F.lit(1))}
    found |= {f"_first_{out}": edge(c, F.min) for out, c in lead.items()}
    found |= {f"_last_{out}": edge(c, F.max) for out, c in lag.items()}
    found |= {f"_high_{out}": F.max(c) for out, c in max_before.items()}
    cells = (
        celled.groupBy(*keys, "_cell")
        .agg(*[v.alias(k) for k, v in found.items()])
    )
    along = Window.partitionBy(*keys).orderBy("_cell")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    border = {
        "_c_before": F.coalesce(F.sum("_c_n").over(earlier), F.lit(0)),
        "_c_total": F.sum("_c_n").over(Window.partitionBy(*keys)),
    }
    border |= {f"_c_{out}": F.lead(f"_first_{out}").over(along) for out in lead}
    border |= {f"_c_{out}": F.lag(f"_last_{out}").over(along) for out in lag}
    border |= {f"_c_{out}": F.max(f"_high_{out}").over(earlier) for out in max_before}
    return cells.select(*keys, "_cell", *[v.alias(k) for k, v in border.items()])


def sequence(
    orders: DataFrame,
    key: str = "customer_id",
    at: str = "ordered_at_gst",
    tie: str = "order_id",
    *,
    hot_rows: int | None,
    cell_rows: int,
) -> DataFrame:
    """Position of each order in its customer's timeline, and its neighbours."""
    placed = ordered_columns(
        orders,
        [key],
        [at, tie],
        row_number="order_seq",
        total="customer_lifetime_orders",
        lead={"next_ordered_at_gst": at},
        lag={"prev_ordered_at_gst": at},
        hot_rows=hot_rows,
        cell_rows=cell_rows,
    )
    return placed.withColumns(
        {
            "prior_order_count": F.col("order_seq") - 1,
            "days_to_next_order": days_between(F.col(at), F.col("next_ordered_at_gst")),
        }
    )
