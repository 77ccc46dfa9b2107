"""Heavy-account detection by robust statistics, and its threshold sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import safe_ratio
from orderlens.operators.joins import with_scalars
from orderlens.operators.quantiles import frequencies, selected_percentiles

# Fixed value: scales a MAD to a standard deviation under normality.
MAD_TO_SIGMA = 1.4826


def entity_activity(df: DataFrame, key: str, date: str) -> DataFrame:
    """Volume, active days and volume per active day of each key.

    Counted per (key, day) first: the distinct count then runs over days, and a
    key with very many rows is already small when it reaches one task.
    """
    daily = df.groupBy(key, date).agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy(key).agg(
        F.sum("n").alias("order_count"),
        F.count(date).alias("active_days"),
        safe_ratio(F.sum("n"), F.count(date)).alias("orders_per_active_day"),
    )


def robust_stats(
    df: DataFrame, col: str, exact: bool = True, cell_rows: int | None = None
) -> DataFrame:
    """One row: median and median absolute deviation of a column.

    ``cell_rows`` selects both medians over cells, for columns with very many values.
    """
    freq = frequencies(df, col)

    def median(of: Column) -> Column:
        if exact:
            return F.percentile(of, 0.5, F.col("n"))
        return F.percentile_approx(of, 0.5, 10000).cast("double")

    def selected(table: DataFrame) -> Column:
        return selected_percentiles(table, [0.5], [], cell_rows).select(F.col("percentiles")[0]).scalar()

    source = freq if exact else df.select(F.col(col).alias("x"))
    by_cells = exact and cell_rows is not None
    center = selected(freq) if by_cells else source.agg(median(F.col("x")).alias("m")).scalar()
    off = source.withColumn("med", center).withColumn("dev", F.abs(F.col("x") - F.col("med")))
    if by_cells:
        spread = off.groupBy(F.col("dev").alias("x")).agg(F.sum("n").alias("n"))
        return off.agg(F.max("med").alias("med")).withColumn("mad", selected(spread))
    return off.agg(F.max("med").alias("med"), median(F.col("dev")).alias("mad"))


def mad_outliers(
    df: DataFrame,
    key: str,
    col: str,
    k: float,
    exact: bool = True,
    cell_rows: int | None = None,
) -> DataFrame:
    """Flag values strictly above median + k scaled MADs; a zero MAD gives NULL."""
    scored = with_scalars(df, robust_stats(df, col, exact, cell_rows))
    threshold = F.col("med") + k * MAD_TO_SIGMA * F.nullif(F.col("mad"), F.lit(0.0))
    return scored.withColumn("threshold", threshold).withColumn(
        "is_outlier", F.col(col) > F.col("threshold")
    )


def customer_activity(orders: DataFrame) -> DataFrame:
    """Per-customer activity of non-cancelled orders."""
    kept = orders.filter(~F.col("is_cancelled"))
    return entity_activity(kept, "customer_id", "order_date_gst")


def detect_test_accounts(activity: DataFrame, k: float) -> DataFrame:
    """Customer activity with the heavy-account flag.

    The activity is read three times (median, deviation, flag): store it first.
    """
    return mad_outliers(activity, "customer_id", "order_count", k).select(
        "customer_id",
        "order_count",
        "active_days",
        "orders_per_active_day",
        F.col("med").alias("med_orders"),
        F.col("mad").alias("mad_orders"),
        "threshold",
        F.col("is_outlier").alias("is_test_account"),
    )


def sweep_threshold(
    activity: DataFrame, ks: Sequence[float], truth: DataFrame, key: str, col: str, label: str
) -> DataFrame:
    """Flagged count, precision and recall for each k.

    Keys are counted per (value, label) first; the ks multiply only those cells.
    """
    stats = robust_stats(activity, col)
    labelled = activity.select(key, F.col(col).alias("x")).join(
        truth.select(key, label), key, "left"
    )
    is_true = F.coalesce(F.col(label), F.lit(False)).alias("is_true")
    cells = labelled.groupBy("x", is_true).agg(F.count(F.lit(1)).alias("n"))
    per_k = F.explode(F.array(*[F.lit(float(k)) for k in ks])).alias("k")
    bar = F.col("med") + F.col("k") * MAD_TO_SIGMA * F.nullif(F.col("mad"), F.lit(0.0))
    spread = with_scalars(cells, stats).select("*", per_k).withColumn("threshold", bar)
    flagged = F.when(F.col("x") > F.col("threshold"), F.col("n")).otherwise(0)
    counted = spread.groupBy("k", "threshold").agg(
        F.sum(flagged).alias("flagged"),
        F.sum(F.when(F.col("is_true"), flagged).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("is_true"), F.col("n")).otherwise(0)).alias("positives"),
    )
    return counted.select(
        "k",
        "threshold",
        "flagged",
        safe_ratio(F.col("hits"), F.col("flagged")).alias("precision"),
        safe_ratio(F.col("hits"), F.col("positives")).alias("recall"),
    )
