"""Staging: cast, rename, and repair one source defect per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.columns import (
    bucket_nulls,
    close_open_range,
    local_date,
    local_hour,
    to_local,
    with_ingest_lag,
)
from orderlens.params import Params


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Earliest row per key, payload intact.

    The rank filter is applied before the exchange as well, so a key with many
    copies sends one row per task.
    """
    first = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    ranked = df.withColumn("_rank", F.row_number().over(first))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def drop_retries(events: DataFrame) -> DataFrame:
    """First physical event per order and type; the retry is the later row."""
    return first_per_key(
        events, ["order_id", "event_type"], ["event_at_utc", "customer_id", "darkstore_id"]
    )


def stage_orders(events: DataFrame, p: Params) -> DataFrame:
    """Event log -> one row per placed order, in the reporting clock.

    Retries, the cancellation lookup and the placed filter are one aggregation by
    order: the earliest placed event is a minimum over whole rows, so its payload
    never mixes two events, and copies collapse before the exchange.
    """
    at = F.col("event_at_utc")
    row = F.struct(at.isNull(), at.alias("at"), F.col("customer_id"), F.col("darkstore_id"))
    kind = F.col("event_type")
    orders = events.groupBy("order_id").agg(
        F.min(F.when(kind == "order_placed", row)).alias("placed"),
        F.count_if(kind == "order_cancelled").alias("n_cancels"),
    )
    utc = F.col("placed.at")
    return orders.filter(F.col("placed").isNotNull()).select(
        "order_id",
        "placed.customer_id",
        "placed.darkstore_id",
        utc.alias("ordered_at_utc"),
        to_local(utc, p.reporting_tz).alias("ordered_at_gst"),
        local_date(utc, p.reporting_tz).alias("order_date_gst"),
        local_hour(utc, p.reporting_tz).alias("order_hour_gst"),
        (F.col("n_cancels") > 0).alias("is_cancelled"),
    )


def stage_order_items(items: DataFrame) -> DataFrame:
    return items.select(
        "order_id",
        "product_id",
        F.col("quantity").cast("int").alias("quantity"),
        "was_stocked_out",
        "was_substituted",
        "substitution_type",
    )


def stage_fulfilment(events: DataFrame, p: Params) -> DataFrame:
    lagged = with_ingest_lag(
        events, "fulfilled_at_utc", "ingested_at_utc", p.late_threshold_minutes
    )
    return lagged.select(
        "order_id",
        "fulfilled_at_utc",
        "ingested_at_utc",
        to_local(F.col("fulfilled_at_utc"), p.reporting_tz).alias("fulfilled_at_gst"),
        "ingestion_lag_minutes",
        "is_late_arriving",
        "had_stockout",
        "substitute_offered",
        "substitute_accepted",
        "substitution_type",
    )


def stage_sessions(sessions: DataFrame, p: Params) -> DataFrame:
    at = F.col("started_at_utc")
    return sessions.select(
        "session_id",
        "customer_id",
        "started_at_utc",
        to_local(at, p.reporting_tz).alias("started_at_gst"),
        local_date(at, p.reporting_tz).alias("session_date_gst"),
        "converted",
        "order_id",
    )


def stage_assignments(assignments: DataFrame, p: Params) -> DataFrame:
    return assignments.select(
        "session_id",
        "customer_id",
        "variant",
        "assigned_at_utc",
        to_local(F.col("assigned_at_utc"), p.reporting_tz).alias("assigned_at_gst"),
    )


def stage_customers(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id",
        "segment",
        F.col("acquired_on").cast("date").alias("acquired_on"),
        "home_darkstore_id",
        F.col("is_test_account").alias("is_test_account_source_flag"),
    )


def stage_products(products: DataFrame, p: Params) -> DataFrame:
    visible = bucket_nulls(products, "category", p.unmapped_label, "is_category_unmapped")
    return visible.select(
        "product_id",
        "category",
        "is_category_unmapped",
        F.col("base_price_aed").cast("double").alias("base_price_aed"),
        F.col("valid_from").cast("date").alias("valid_from"),
        close_open_range(F.col("valid_to")).alias("valid_to"),
        "is_current",
    )


def stage_darkstores(stores: DataFrame) -> DataFrame:
    return stores.select(
        "darkstore_id",
        "darkstore_name",
        "area",
        F.col("affluence_index").cast("double").alias("affluence_index"),
        F.col("opened_on").cast("date").alias("opened_on"),
        F.col("catchment_radius_km").cast("double").alias("catchment_radius_km"),
        F.col("valid_from").cast("date").alias("valid_from"),
        close_open_range(F.col("valid_to")).alias("valid_to"),
        "is_current",
    )
