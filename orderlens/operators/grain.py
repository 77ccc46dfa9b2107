"""Item fill and order fill, side by side.

``item_fill_macro`` is the mean of per-order rates; ``item_fill_micro`` weighs
every item the same. They differ, so neither is ever called just a fill rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import (
    band,
    band_index,
    order_fill_identity,
    required_miss,
    safe_ratio,
    share,
)
from orderlens.params import BASKET_EDGES, BASKET_LABELS


def _measures() -> list[Column]:
    kept = F.sum("n_items") - F.sum("n_stocked_out")
    return [
        F.count(F.lit(1)).alias("orders"),
        F.sum("n_items").alias("items"),
        F.avg("n_items").alias("mean_basket"),
        F.avg("item_fill_rate").alias("item_fill_macro"),
        safe_ratio(kept, F.sum("n_items")).alias("item_fill_micro"),
        share(F.col("is_clean_order")).alias("order_fill"),
    ]


def _with_miss(rates: DataFrame) -> DataFrame:
    return rates.withColumns(
        {
            "item_miss_rate": 1 - F.col("item_fill_macro"),
            "gap_pp": (F.col("item_fill_macro") - F.col("order_fill")) * 100,
        }
    )


def grain_summary(orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both fill rates, the item miss rate and their gap in percentage points."""
    return _with_miss(orders.groupBy(*by).agg(*_measures()))


def with_band(orders: DataFrame, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    return orders.withColumns(
        {
            "basket_band": band(F.col("n_items"), edges, labels),
            "ord": band_index(F.col("n_items"), edges),
        }
    )


def grain_by_band(
    orders: DataFrame,
    edges: Sequence[float] = BASKET_EDGES,
    labels: Sequence[str] = BASKET_LABELS,
) -> DataFrame:
    """Both fill rates per basket size band, in band order."""
    banded = with_band(orders, edges, labels)
    return banded.groupBy("basket_band", "ord").agg(*_measures()).orderBy("ord")


def grain_with_total(
    orders: DataFrame, edges: Sequence[float], labels: Sequence[str]
) -> DataFrame:
    """The bands and, with a NULL band, all orders together, in one scan."""
    banded = with_band(orders, edges, labels)
    keys = [F.col("basket_band"), F.col("ord")]
    return _with_miss(banded.groupingSets([[], keys], *keys).agg(*_measures()))


def fill_by_day(orders: DataFrame, date: str = "order_date_gst") -> DataFrame:
    return orders.groupBy(date).agg(*_measures())


def identity_gap(orders: DataFrame) -> DataFrame:
    """Order fill against the identity at the mean basket (a Jensen gap, in pp)."""
    identity = order_fill_identity(F.col("item_miss_rate"), F.col("mean_basket"))
    return grain_summary(orders).select(
        "item_miss_rate",
        "mean_basket",
        "order_fill",
        identity.alias("identity_at_mean"),
        ((F.col("order_fill") - identity) * 100).alias("gap_pp"),
    )


def fill_curve(miss: DataFrame, n_max: int = 25, col: str = "item_miss_rate") -> DataFrame:
    """Order fill implied by each miss rate for baskets of 1 to n_max items."""
    sizes = F.explode(F.sequence(F.lit(1), F.lit(n_max))).alias("n_items")
    fill = order_fill_identity(F.col(col), F.col("n_items"))
    return miss.select("*", sizes).withColumn("order_fill", fill)


def required_fill(
    baskets: DataFrame, target: float, size: str = "n_items", floor: float = 0.005
) -> DataFrame:
    """Item fill needed for an order fill target; infeasible below the miss floor."""
    miss = required_miss(F.lit(float(target)), F.col(size))
    return baskets.withColumns(
        {
            "required_miss": miss,
            "required_item_fill": 1 - miss,
            "is_infeasible": miss < floor,
        }
    )
