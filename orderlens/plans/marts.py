"""Dimensions and facts of the star schema, each a function of its inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.columns import (
    days_between,
    decode_rank,
    in_set_flag,
    joined_flag,
    line_value,
    safe_ratio,
    surrogate_key,
    tenure,
)
from orderlens.operators.joins import left_join_sparse, max_date
from orderlens.operators.rollup import rollup_items
from orderlens.operators.scd2 import scd2_join
from orderlens.operators.timeline import sequence
from orderlens.params import SWAP_SEVERITY, Params


def dim_product(products: DataFrame) -> DataFrame:
    key = surrogate_key(F.col("product_id"), F.col("valid_from"))
    return products.select(
        key.alias("product_key"),
        "product_id",
        "category",
        "is_category_unmapped",
        "base_price_aed",
        "valid_from",
        "valid_to",
        "is_current",
    )


def dim_darkstore(stores: DataFrame) -> DataFrame:
    key = surrogate_key(F.col("darkstore_id"), F.col("valid_from"))
    return stores.select(
        key.alias("darkstore_key"),
        "darkstore_id",
        "darkstore_name",
        "area",
        "affluence_index",
        "opened_on",
        "catchment_radius_km",
        "valid_from",
        "valid_to",
        "is_current",
    )


def dim_customer(customers: DataFrame, accounts: DataFrame) -> DataFrame:
    found = accounts.select("customer_id", "is_test_account", "order_count")
    return customers.join(found, "customer_id", "left").select(
        F.col("customer_id").alias("customer_key"),
        "customer_id",
        "segment",
        "acquired_on",
        "home_darkstore_id",
        "is_test_account_source_flag",
        F.coalesce("is_test_account", F.lit(False)).alias("is_test_account"),
        F.coalesce("order_count", F.lit(0)).alias("lifetime_orders"),
    )


def calendar(spark: SparkSession, start: str | Column, end: str | Column) -> DataFrame:
    """One row per day of [start, end) with the business calendar."""
    first, stop = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    first, last = first.cast("date"), F.date_sub(stop.cast("date"), 1)
    d = F.col("date_gst")
    weekday, day = F.dayofweek(d) - 1, F.dayofmonth(d)
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("date_gst"))
    return days.select(
        d,
        F.year(d).cast("bigint").alias("year"),
        F.month(d).cast("bigint").alias("month"),
        day.cast("bigint").alias("day_of_month"),
        weekday.cast("bigint").alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.trunc(d, "week").alias("week_start"),
        F.trunc(d, "month").alias("month_start"),
        weekday.isin(0, 6).alias("is_weekend"),
        ((day >= 25) | (day <= 2)).alias("is_payday_window"),
    )


def fct_order_items(
    items: DataFrame, orders: DataFrame, products: DataFrame, p: Params, carry: bool = False
) -> DataFrame:
    """Order lines with the price and category live on the order date."""
    placed = orders.select("order_id", "customer_id", "darkstore_id", "order_date_gst")
    priced = scd2_join(
        items.join(placed, "order_id"),
        products,
        "product_id",
        "order_date_gst",
        ["product_key", "category", "is_category_unmapped", "base_price_aed"],
        carry=carry,
    )
    return priced.select(
        "order_id",
        "product_id",
        "product_key",
        "customer_id",
        "darkstore_id",
        "order_date_gst",
        "quantity",
        "category",
        "is_category_unmapped",
        "base_price_aed",
        line_value(F.col("quantity"), F.col("base_price_aed")).alias("line_value_aed"),
        "was_stocked_out",
        "was_substituted",
        "substitution_type",
        in_set_flag(F.col("category"), p.high_intent_categories).alias("is_high_intent_category"),
    )


def fct_orders(
    items: DataFrame,
    orders: DataFrame,
    fulfilment: DataFrame,
    stores: DataFrame,
    carry: bool = False,
) -> DataFrame:
    """One row per order with items; both fill rates side by side.

    Items, orders and fulfilment meet on order_id, so one partitioning serves the
    rollup and both joins.
    """
    picked = fulfilment.select(
        "order_id",
        "substitute_offered",
        "substitute_accepted",
        "ingestion_lag_minutes",
        "is_late_arriving",
    )
    joined = orders.join(rollup_items(items), "order_id").join(picked, "order_id", "left")
    placed = scd2_join(
        joined,
        stores,
        "darkstore_id",
        "order_date_gst",
        ["darkstore_key", "opened_on"],
        carry=carry,
    )
    clean = F.col("n_items") - F.col("n_stocked_out")
    return placed.select(
        "order_id",
        "customer_id",
        "darkstore_key",
        "darkstore_id",
        "order_date_gst",
        "order_hour_gst",
        "ordered_at_gst",
        "is_cancelled",
        "n_items",
        "n_units",
        "gross_value_aed",
        "n_stocked_out",
        safe_ratio(clean, F.col("n_items")).alias("item_fill_rate"),
        (~F.col("had_any_stockout")).alias("is_clean_order"),
        F.col("had_any_stockout").alias("had_stockout"),
        "had_high_intent_stockout",
        "n_substituted",
        "substitute_offered",
        "substitute_accepted",
        decode_rank(F.col("worst_sub_rank"), SWAP_SEVERITY).alias("substitution_type"),
        "ingestion_lag_minutes",
        "is_late_arriving",
        days_between(F.col("opened_on"), F.col("order_date_gst")).alias("store_age_days_at_order"),
    )


def customer_order_sequence(orders: DataFrame, p: Params) -> DataFrame:
    """Non-cancelled orders in their customer's timeline."""
    kept = orders.filter(~F.col("is_cancelled")).select(
        "order_id",
        "customer_id",
        "darkstore_id",
        "ordered_at_gst",
        "order_date_gst",
        "order_hour_gst",
        "is_cancelled",
    )
    return sequence(kept, hot_rows=p.hot_rows, cell_rows=p.cell_rows)


def with_outcome(df: DataFrame, orders: DataFrame, window_days: int) -> DataFrame:
    """Repeat outcome, and whether its window lies fully inside the data."""
    newest = max_date(orders, "order_date_gst").scalar()
    return df.withColumns(
        {
            "repeat_within_30d": F.col("days_to_next_order") <= window_days,
            "is_observable_30d": F.col("order_date_gst") <= F.date_sub(newest, window_days),
        }
    )


# The columns of an order that the tables built on it carry.
OF_CUSTOMER_ORDERS = (
    "n_items",
    "gross_value_aed",
    "item_fill_rate",
    "is_clean_order",
    "had_stockout",
    "had_high_intent_stockout",
    "substitute_offered",
    "substitute_accepted",
    "substitution_type",
    "store_age_days_at_order",
)
OF_SESSIONS = (
    "had_stockout",
    "substitute_offered",
    "substitute_accepted",
    "substitution_type",
    "gross_value_aed",
)


def fct_customer_orders(
    placed: DataFrame, staged: DataFrame, orders: DataFrame, customers: DataFrame, p: Params
) -> DataFrame:
    """Sequenced orders with order facts, customer attributes and the outcome.

    Facts that ``orders`` was stored without are left out.
    """
    known = [name for name in OF_CUSTOMER_ORDERS if name in orders.columns]
    facts = orders.select("order_id", *known)
    who = customers.select("customer_id", "segment", "is_test_account")
    # The customer first: the rows still lie by customer from the window before.
    joined = placed.join(who, "customer_id", "left").join(facts, "order_id")
    labelled = with_outcome(joined, staged, p.retention_window_days).withColumn(
        "tenure", tenure(F.col("prior_order_count"), p.tenure_new_max_prior_orders)
    )
    return labelled.select(
        "order_id",
        "customer_id",
        "segment",
        "is_test_account",
        "darkstore_id",
        "order_date_gst",
        "order_hour_gst",
        "order_seq",
        "prior_order_count",
        "tenure",
        *known,
        "days_to_next_order",
        "repeat_within_30d",
        "is_observable_30d",
    )


def fct_sessions(
    sessions: DataFrame, assignments: DataFrame, orders: DataFrame, customers: DataFrame
) -> DataFrame:
    """Every session, whether or not it was assigned or converted.

    Facts that ``orders`` was stored without are left out.
    """
    arms = assignments.select("session_id", "variant")
    known = [name for name in OF_SESSIONS if name in orders.columns]
    facts = orders.select("order_id", *known)
    who = customers.select("customer_id", "segment", "is_test_account")
    assigned = sessions.join(arms, "session_id", "left")
    joined = left_join_sparse(assigned, facts, "order_id").join(who, "customer_id", "left")
    return joined.select(
        "session_id",
        "customer_id",
        "segment",
        "is_test_account",
        "session_date_gst",
        "started_at_gst",
        "variant",
        joined_flag(F.col("variant")).alias("is_in_experiment"),
        "converted",
        "order_id",
        *known,
    )
