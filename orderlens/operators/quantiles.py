"""Exact order statistics over a frequency table.

Rows are first counted per distinct value, so a hot value is one row before any
percentile is taken. For per-key counts (orders of a customer, items of an
order) the number k of distinct values is bounded: they sum to at most N rows,
hence k(k+1)/2 <= N and k <= sqrt(2N), about 1.4 million for 10^12 rows. One
task merges them.

Continuous columns have no such bound. With ``cell_rows`` the distinct values are
range-partitioned into cells, counted per cell, and only the cells that hold a wanted
rank are sorted. The result is the same, and no task holds more than a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.operators.ranks import beside, borders, cells


def frequencies(
    df: DataFrame, col: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """by..., x, n: how often each non-null value occurs."""
    known = df.filter(F.col(col).isNotNull())
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return known.groupBy(*by, F.col(col).alias("x")).agg(times.alias("n"))


def exact_percentiles(
    df: DataFrame,
    col: str,
    points: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """by..., percentiles: interpolated percentiles as one array."""
    freq = frequencies(df, col, by, weight)
    if cell_rows is not None:
        return selected_percentiles(freq, points, by, cell_rows)
    array = F.array(*[F.lit(float(p)) for p in points])
    return freq.groupBy(*by).agg(F.percentile("x", array, F.col("n")).alias("percentiles"))


def selected_percentiles(
    freq: DataFrame, points: Sequence[float], by: Sequence[str], cell_rows: int
) -> DataFrame:
    """by..., percentiles from a frequency table (by..., x, n), by selection.

    A percentile lies between the values at two ranks. The counts of the cells tell in
    which cells these ranks lie; the running count inside those cells finds the values.
    """
    celled = cells(freq, by, ["x"], cell_rows)
    places = [(F.col("_total") - 1) * float(p) for p in points]
    ranks = [r.cast("bigint") for p in places for r in (F.floor(p), F.ceil(p))]
    start, inside = F.col("_start"), F.col("_inside")
    here = F.filter(F.array_distinct(F.array(*ranks)), lambda r: (r >= start) & (r < start + inside))
    wanted = borders(celled, by, F.col("n")).withColumn("_ranks", here).filter(F.size("_ranks") > 0)
    prior = Window.partitionBy(*by, "_cell").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    rows = beside(celled, wanted.select(*by, "_cell", "_start", "_total", "_ranks"), [*by, "_cell"])
    first = F.col("_start") + F.coalesce(F.sum("n").over(prior), F.lit(0))
    rows = rows.withColumn("_first", first)
    held = F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("n")))
    found = rows.select(*by, "_total", F.col("x").cast("double").alias("x"), F.explode(held).alias("rank"))
    values = F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_at")
    table = found.groupBy(*by).agg(F.first("_total").alias("_total"), values)

    def between(place: Column) -> Column:
        low, high = F.floor(place).cast("bigint"), F.ceil(place).cast("bigint")
        below, above = F.col("_at")[low], F.col("_at")[high]
        mixed = (high - place) * below + (place - low) * above
        return F.when(below == above, below).otherwise(mixed)

    picked = table.select(*by, F.array(*[between(p) for p in places]).alias("percentiles"))
    if by:
        return picked
    none = F.array(*[F.lit(None).cast("double") for _ in points])
    return picked.agg(F.coalesce(F.first("percentiles"), none).alias("percentiles"))


def quantile_bucket(
    df: DataFrame,
    col: str,
    buckets: int,
    out: str,
    by: Sequence[str] = (),
    weight: str | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """0-based quantile bucket with right-closed bins and repeated edges merged.

    Ties are never split: a value sits in the first bin whose upper edge reaches
    it, so tied columns give fewer and unequal buckets.
    """
    points = [i / buckets for i in range(buckets + 1)]
    edges = exact_percentiles(df, col, points, by, weight, cell_rows)
    merged = F.array_distinct("percentiles")
    inner = F.slice(merged, 2, F.greatest(F.size(merged) - 2, F.lit(0))).alias("_inner")

    def bucket(inner_edges: Column) -> Column:
        below = F.size(F.filter(inner_edges, lambda e: e < F.col(col)))
        return F.when(F.col(col).isNotNull(), below)

    if not by:
        return df.withColumn("_inner", edges.select(inner).scalar()).withColumn(
            out, bucket(F.col("_inner"))
        ).drop("_inner")
    # No hint: at run time the planner knows the size of the aggregated side.
    cut = beside(df, edges.select(*by, inner), by, "left")
    return cut.withColumn(out, bucket(F.col("_inner"))).select(*df.columns, out)


def quantile_profile(
    df: DataFrame, col: str, by: Sequence[str], exact: bool = True, cell_rows: int | None = None
) -> DataFrame:
    """n, minimum, median, 99th percentile and maximum of a column per class."""
    if exact and cell_rows is not None:
        points = exact_percentiles(df, col, [0.0, 0.5, 0.99, 1.0], by, cell_rows=cell_rows)
        counts = df.groupBy(*by).agg(F.count(col).alias("n"))
        q = F.col("percentiles")
        grouped = beside(counts, points, by).withColumns(
            {"lowest": q[0], "highest": q[3], "q": F.slice(q, 2, 2)}
        )
    elif exact:
        freq = frequencies(df, col, by)
        pick = F.percentile("x", F.array(F.lit(0.5), F.lit(0.99)), F.col("n"))
        grouped = freq.groupBy(*by).agg(
            F.sum("n").alias("n"), F.min("x").alias("lowest"), F.max("x").alias("highest"),
            pick.alias("q"),
        )
    else:
        grouped = df.groupBy(*by).agg(
            F.count(col).alias("n"), F.min(col).alias("lowest"), F.max(col).alias("highest"),
            F.percentile_approx(col, [0.5, 0.99], 10000).alias("q"),
        )
    return grouped.select(
        *by,
        "n",
        F.col("lowest").cast("double").alias("lowest"),
        F.col("q")[0].cast("double").alias("median"),
        F.col("q")[1].cast("double").alias("p99"),
        F.col("highest").cast("double").alias("highest"),
    )
