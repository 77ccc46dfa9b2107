"""Order-item lines rolled up to the order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import encode_rank
from orderlens.params import SWAP_SEVERITY


def rollup_items(items: DataFrame) -> DataFrame:
    """One row per order from priced lines; the order's swap type is its worst.

    Every buffer is a fixed-width number, so the partial aggregation runs in the
    hash map before the exchange and a huge order shrinks to one row per task.
    """
    out = F.coalesce(F.col("was_stocked_out"), F.lit(False))
    urgent = out & F.coalesce(F.col("is_high_intent_category"), F.lit(False))
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("quantity").alias("n_units"),
        F.sum("line_value_aed").alias("gross_value_aed"),
        F.count_if(out).alias("n_stocked_out"),
        (F.count_if(out) > 0).alias("had_any_stockout"),
        (F.count_if(urgent) > 0).alias("had_high_intent_stockout"),
        F.count_if("was_substituted").alias("n_substituted"),
        F.min(encode_rank(F.col("substitution_type"), SWAP_SEVERITY)).alias("worst_sub_rank"),
    )
