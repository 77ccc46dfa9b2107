"""Registered queries: one per operator family, over the whole given tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from datetime import timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.columns import split_offer
from orderlens.operators import checks, metrics, outliers, scd2, scoring, staging, stats
from orderlens.operators import effects as E
from orderlens.operators import experiment as X
from orderlens.operators import grain as G
from orderlens.operators import joins as J
from orderlens.operators.quantiles import quantile_bucket, quantile_profile
from orderlens.operators.timeline import sequence
from orderlens.plans import incremental, marts, reports
from orderlens.plans.run import score_run
from orderlens.plans.warehouse import Warehouse
from orderlens.session import configure, keep, work_dir
from orderlens.sources import raw, tables
from orderlens.sources.tpch import TPCH_PARAMS, TpchSources

P = TPCH_PARAMS

# Columns of facts that several parts of one query read, stored for it without the others.
ARM_COLUMNS = {"fct_orders": ("order_id", "n_items")}
SEQUENCE_COLUMNS = {"fct_orders": (
    "order_id", "customer_id", "ordered_at_gst", "order_date_gst", "is_late_arriving", "is_cancelled")}
CHECKED_COLUMNS = {
    "fct_order_items": (
        "order_id", "product_key", "category", "quantity", "line_value_aed", "was_stocked_out",
        "was_substituted", "substitution_type", "is_high_intent_category"),  # with those of the rollup
    "fct_orders": ("order_id", "customer_id", "darkstore_key", "order_date_gst", "n_items",
                   "item_fill_rate", "is_clean_order"),
    "fct_customer_orders": ("order_id", "order_date_gst", "tenure", "is_observable_30d"),
    "fct_sessions": ("session_id", "variant"),
}
REPORT_COLUMNS = {
    "fct_orders": (
        "order_id", "is_cancelled", "n_items", "n_stocked_out", "item_fill_rate", "is_clean_order",
        "had_stockout", "had_high_intent_stockout", "substitute_offered", "substitute_accepted",
        "substitution_type"),
    "fct_customer_orders": (
        "order_id", "segment", "is_test_account", "tenure", "n_items", "had_stockout",
        "had_high_intent_stockout", "substitute_offered", "substitute_accepted",
        "substitution_type", "repeat_within_30d", "is_observable_30d"),
}

# Parameters of single queries, shared with their SQL twins.
SWEEP = (1.0, 2.0, 3.0, 4.0)
FILL_TARGET = 0.97
CURVE_MAX = 25
LOOKBACK_DAYS = 45
LATE_MONTHS = 3
TRUE_EFFECTS = {"new": -9.0, "established": -3.0}
TRUE_REPAIR = {
    "same_brand_diff_size": 0.6,
    "diff_brand_same_product": 0.4,
    "diff_product_same_cat": 0.1,
}


class Context:
    """The tables of one folder: lazy, and as a stored warehouse."""

    def __init__(self, spark: SparkSession, folder: str, state: str):
        self.spark = spark
        self.sources = TpchSources(spark, folder)
        app = spark.sparkContext.applicationId
        self.root = f"{work_dir(spark)}/orderlens/{app}/{state}"
        self._narrow: dict[str, Warehouse] = {}

    def fresh(self, name: str) -> str:
        """A new folder per call: an earlier result may not have been read yet."""
        return f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return self.sources.all()

    @cached_property
    def lazy(self) -> Warehouse:
        return Warehouse(self.spark, self.raw, P)

    @cached_property
    def stored(self) -> Warehouse:
        return Warehouse(self.spark, self.raw, P, f"{self.root}/tables")

    def narrow(self, columns: Mapping[str, Sequence[str]] | None = None) -> Warehouse:
        """The model for queries that need few columns of the facts, one for each choice."""
        chosen = {name: tuple(names) for name, names in sorted((columns or {}).items())}
        key = hashlib.md5(repr(chosen).encode()).hexdigest()[:12]
        if key not in self._narrow:
            self._narrow[key] = self.stored.narrow(f"{self.root}/narrow-{key}", chosen)
        return self._narrow[key]

    @property
    def clean_orders(self) -> DataFrame:
        return E.population(self.stored["fct_orders"], not_cancelled=True)

    @property
    def focal(self) -> DataFrame:
        return E.focal_orders(self.stored["fct_customer_orders"])

    @property
    def exposed(self) -> DataFrame:
        return split_offer(E.population(self.focal, exposed=True))

    @cached_property
    def cells(self) -> DataFrame:
        """Focal orders counted per combination of attributes, once per application."""
        return keep(E.focal_cells(E.focal_orders(self.narrow()["fct_customer_orders"])))

    @property
    def exposed_cells(self) -> DataFrame:
        return E.population(self.cells, exposed=True)

    @property
    def frame(self) -> DataFrame:
        w = self.narrow(ARM_COLUMNS)
        return X.experiment_frame(w["fct_sessions"], w["fct_orders"], w["fct_customer_orders"])

    @cached_property
    def arms(self) -> DataFrame:
        """One row with both arms' statistics, computed once per application."""
        counted = X.arm_statistics(self.frame, "variant", "n_items")
        return keep(X.side_by_side(counted, "variant", "control", "treatment"))

    @property
    def activity(self) -> DataFrame:
        return self.stored["int_customer_activity"]


def rounded(df: DataFrame, digits: int = 8, /, **special: int) -> DataFrame:
    """Doubles to a fixed number of decimals, so two engines agree on the value."""
    cols = [
        (F.round(f.name, special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


REGISTRY: dict[str, Callable[[Context], DataFrame]] = {}


def query(fn: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


# --- sources and sinks -----------------------------------------------------
def _csv_schemas(c: Context) -> dict[str, str]:
    """Declared CSV types of these tables: integer keys instead of text."""
    return {n: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
            for n, df in c.raw.items()}


@query
def landing_counts(c: Context) -> DataFrame:
    folder = c.fresh("csv")
    for name, df in c.raw.items():
        raw.write_csv(df, folder, name)
    return raw.landing_counts(raw.land_raw(c.spark, folder, c.fresh("raw"), _csv_schemas(c)))


@query
def source_catalog(c: Context) -> DataFrame:
    return raw.source_catalog(c.spark, c.raw)


@query
def fact_layout(c: Context) -> DataFrame:
    path = c.fresh("fact_layout")
    orders = c.stored["fct_orders"].withColumn("order_month", F.trunc("order_date_gst", "month"))
    tables.write_fact(orders, path, "order_month", ["darkstore_id", "order_date_gst"])
    stored = c.spark.read.parquet(path)
    return rounded(
        stored.groupBy("order_month").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("n_items").alias("items"),
            F.sum("gross_value_aed").alias("gross_value_aed"),
        ), 3,
    )


@query
def lookback_overwrite(c: Context) -> DataFrame:
    path = c.fresh("lookback")
    orders = c.stored["fct_orders"].select(
        F.trunc("order_date_gst", "month").alias("order_month"), "order_id", "is_late_arriving"
    )
    tables.write_fact(orders.filter(~F.col("is_late_arriving")), path, "order_month")
    tables.overwrite_lookback(orders, path, "order_month", LOOKBACK_DAYS)
    stored = c.spark.read.parquet(path)
    return stored.groupBy("order_month").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("is_late_arriving").alias("late_orders")
    )


@query
def lookback_lost_day(c: Context) -> DataFrame:
    """The newest months again, one of which has lost all its rows meanwhile."""
    path = c.fresh("lookback_lost")
    orders = c.stored["fct_orders"].select(
        F.trunc("order_date_gst", "month").alias("order_month"), "order_id"
    )
    newest = orders.agg(F.max("order_month")).scalar()
    tables.write_fact(orders, path, "order_month")
    kept = orders.filter(F.col("order_month") != F.add_months(newest, -1))
    tables.overwrite_lookback(kept, path, "order_month", LOOKBACK_DAYS)
    stored = tables.read_mart(c.spark, *path.rsplit("/", 1))
    return stored.groupBy("order_month").agg(F.count(F.lit(1)).alias("orders"))


@query
def lookback_late_run(c: Context) -> DataFrame:
    """A run that comes late: its input ends months before the newest of the table."""
    path = c.fresh("lookback_late")
    orders = c.stored["fct_orders"].select(
        F.trunc("order_date_gst", "month").alias("order_month"), "order_id", "is_late_arriving"
    )
    newest = orders.agg(F.max("order_month")).scalar()
    tables.write_fact(orders, path, "order_month")
    older = orders.filter((F.col("order_month") <= F.add_months(newest, -LATE_MONTHS)) & ~F.col("is_late_arriving"))
    tables.overwrite_lookback(older, path, "order_month", LOOKBACK_DAYS)
    stored = tables.read_mart(c.spark, *path.rsplit("/", 1))
    return stored.groupBy("order_month").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("is_late_arriving").alias("late_orders")
    )


@query
def metric_table(c: Context) -> DataFrame:
    names = ("order_fill", "item_fill_macro", "item_fill_micro", "mean_basket")
    by_band = G.grain_by_band(c.clean_orders)
    by_tenure = E.effect(c.focal, "repeated", "had_stockout", ["tenure"], [[], ["tenure"]])
    rows = metrics.stack(
        metrics.metric_rows(by_band, "grain_by_band", {n: n for n in names},
                            F.col("basket_band"), n="orders"),
        metrics.metric_rows(by_tenure, "stockout", {"effect_pp": "effect_pp"},
                            F.coalesce("tenure", F.lit("all")), "ci_lo", "ci_hi", "n"),
    )
    path = c.fresh("metric_table")
    tables.write_metrics(rows, path)
    return rounded(tables.read_metrics(c.spark, path)).withColumnRenamed("by", "group_by")


# --- staging ---------------------------------------------------------------
@query
def stage_customers(c: Context) -> DataFrame:
    return c.lazy["stg_customers"]


@query
def stage_products(c: Context) -> DataFrame:
    return rounded(c.lazy["stg_products"])


@query
def stage_darkstores(c: Context) -> DataFrame:
    return rounded(c.lazy["stg_darkstores"])


@query
def stage_orders(c: Context) -> DataFrame:
    return c.lazy["stg_orders"]


@query
def stage_order_items(c: Context) -> DataFrame:
    return c.lazy["stg_order_items"]


@query
def ingest_lag(c: Context) -> DataFrame:
    return c.lazy["stg_fulfilment"]


@query
def stage_sessions(c: Context) -> DataFrame:
    return c.lazy["stg_sessions"]


@query
def stage_assignments(c: Context) -> DataFrame:
    return c.lazy["stg_experiment_assignments"]


@query
def dedup_events(c: Context) -> DataFrame:
    return staging.drop_retries(c.raw["raw_order_events"])


# --- dimensions ------------------------------------------------------------
@query
def dim_product(c: Context) -> DataFrame:
    return rounded(c.stored["dim_product"])


@query
def dim_darkstore(c: Context) -> DataFrame:
    return rounded(c.stored["dim_darkstore"])


@query
def dim_customer(c: Context) -> DataFrame:
    return c.stored["dim_customer"]


def _order_calendar(c: Context) -> DataFrame:
    day = F.col("order_date_gst")
    ends = F.struct(F.min(day).alias("first"), F.date_add(F.max(day), 1).alias("stop"))
    bounds = c.stored["stg_orders"].agg(ends).scalar()
    return marts.calendar(c.spark, bounds["first"], bounds["stop"])


@query
def calendar(c: Context) -> DataFrame:
    return _order_calendar(c)


@query
def dim_date(c: Context) -> DataFrame:
    return c.stored["dim_date"]


@query
def scd2_products(c: Context) -> DataFrame:
    changes = c.sources.product_changes()
    return rounded(scd2.scd2_from_changes(changes, ["product_id"], "at"))


@query
def scd2_price_asof(c: Context) -> DataFrame:
    """Value by category and price version, priced as of the order date."""
    w = c.stored
    placed = w["stg_order_items"].join(
        w["stg_orders"].select("order_id", "order_date_gst"), "order_id"
    )
    priced = scd2.scd2_join(
        placed, w["dim_product"], "product_id", "order_date_gst",
        ["category", "base_price_aed", "is_current"], fan_out_guard=True,
    )
    value = F.col("quantity") * F.col("base_price_aed")
    return rounded(
        priced.groupBy("category", "is_current").agg(
            F.count(F.lit(1)).alias("lines"), F.sum(value).alias("value_aed")
        ), 3,
    )


def _overlapping_products(c: Context) -> DataFrame:
    """The catalogue with every closed version ending 30 days late."""
    late = F.when(~F.col("is_current"), F.date_add("valid_to", 30)).otherwise(F.col("valid_to"))
    return c.stored["dim_product"].withColumn("valid_to", late)


@query
def scd2_overlaps(c: Context) -> DataFrame:
    return scd2.check_no_overlap(_overlapping_products(c), "product_id")


@query
def scd2_overlap_pairs(c: Context) -> DataFrame:
    return scd2.overlapping_pairs(_overlapping_products(c), "product_id")


@query
def scd2_asof_many_versions(c: Context) -> DataFrame:
    """Three keys with a version for each order date, each joined to a third of all lines."""
    lines = c.stored["fct_order_items"].select(
        (F.col("product_id") % 3).alias("key"),
        "order_id",
        "product_id",
        F.date_add("order_date_gst", (F.col("product_id") % 5).cast("int")).alias("day"),
        F.col("order_date_gst").alias("since"),
        "quantity",
    )
    daily = lines.groupBy("key", "since").agg(F.sum("quantity").alias("units"))
    versions = scd2.scd2_from_changes(daily, ["key"], "since")
    closed = versions.withColumn("valid_to", F.least("valid_to", F.date_add("valid_from", 2)))
    share = max(lines.count() // 20, 1)
    priced = scd2.asof_join(
        lines.select("key", "order_id", "product_id", "day"), closed, "key", "day", ["units"],
        hot_rows=share, cell_rows=share,
    )
    return priced.groupBy("key", F.trunc("day", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"), F.count("units").alias("dated"), F.sum("units").alias("units")
    )


# --- facts -----------------------------------------------------------------
@query
def order_items_fact(c: Context) -> DataFrame:
    return rounded(c.stored["fct_order_items"])


@query
def orders_fact(c: Context) -> DataFrame:
    return rounded(c.stored["fct_orders"])


@query
def customer_sequence(c: Context) -> DataFrame:
    return c.stored["int_customer_order_sequence"]


@query
def customer_sequence_split(c: Context) -> DataFrame:
    """The same sequence with the heaviest keys split over cells.

    A key is hot above a thousandth of the rows, so at most 1,000 keys are.
    """
    orders = c.stored["stg_orders"]
    limit = max(orders.count() // 1000, 1)
    split = replace(P, hot_rows=limit, cell_rows=10 * limit)
    return marts.customer_order_sequence(orders, split)


@query
def customer_sequence_batch(c: Context) -> DataFrame:
    """One key with a third of the orders, half of them stamped with one instant."""
    orders = c.stored["stg_orders"]
    large = F.col("customer_id") % 3 == 0
    stamped = large & (F.col("order_id") % 2 == 0)
    orders = orders.withColumns(
        {
            "ordered_at_gst": F.when(stamped, F.lit("2026-02-01 12:00:00").cast("timestamp_ntz"))
            .otherwise(F.col("ordered_at_gst")),
            "customer_id": F.when(large, F.lit(-1)).otherwise(F.col("customer_id")).cast(
                orders.schema["customer_id"].dataType),
        }
    )
    kept = orders.filter("NOT is_cancelled").select("order_id", "customer_id", "ordered_at_gst")
    share = max(kept.count() // 50, 1)
    split = sequence(kept, hot_rows=share, cell_rows=max(share // 4, 1))
    return split.select(
        "order_id", "customer_id", "order_seq", "customer_lifetime_orders", "next_ordered_at_gst",
        "prev_ordered_at_gst", "days_to_next_order")


@query
def customer_sequence_lookback(c: Context) -> DataFrame:
    """A stored sequence without its late orders, after the lookback has brought the recent ones."""
    orders = c.narrow(SEQUENCE_COLUMNS)["fct_orders"].filter("NOT is_cancelled").select(
        "order_id", "customer_id", "ordered_at_gst", "order_date_gst", "is_late_arriving"
    )
    path = c.fresh("sequence")
    incremental.store_sequence(orders.filter("NOT is_late_arriving"), path, parts=16, params=P)
    newest = orders.agg(F.max("order_date_gst")).first()[0]
    cut = newest - timedelta(days=LOOKBACK_DAYS)
    incremental.resequence(orders, path, "order_date_gst", cut, newest, parts=16, params=P)
    return tables.read_mart(c.spark, *path.rsplit("/", 1)).drop("part")


@query
def customer_orders_fact(c: Context) -> DataFrame:
    return rounded(c.stored["fct_customer_orders"])


@query
def sessions_fact(c: Context) -> DataFrame:
    return rounded(c.narrow()["fct_sessions"])


@query
def flagged_account_orders(c: Context) -> DataFrame:
    """Semi and anti filter of the orders by the flagged-account key set."""
    w = c.stored
    flagged = w["dim_customer"].filter("is_test_account").select("customer_id")
    parts = {
        "flagged": J.keep_keys(w["fct_orders"], flagged, ["customer_id"]),
        "others": J.drop_keys(w["fct_orders"], flagged, ["customer_id"]),
    }
    counted = [
        df.agg(F.lit(name).alias("accounts"), F.count(F.lit(1)).alias("orders"),
               F.sum("n_items").alias("items"))
        for name, df in parts.items()
    ]
    return metrics.stack(*counted)


@query
def densified_daily_orders(c: Context) -> DataFrame:
    """Orders per store and day, with the days on which a store had none."""
    daily = c.stored["fct_orders"].groupBy("darkstore_id", "order_date_gst").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("n_items").alias("items")
    )
    days = _order_calendar(c).select(F.col("date_gst").alias("order_date_gst"))
    return J.densify(daily, days, "order_date_gst", ["darkstore_id"], ["orders", "items"])


# --- outliers and profiles -------------------------------------------------
@query
def mad_outliers(c: Context) -> DataFrame:
    return rounded(c.stored["int_test_accounts"])


@query
def threshold_sweep(c: Context) -> DataFrame:
    truth = c.sources.truth_flags()
    return rounded(
        outliers.sweep_threshold(
            c.activity, SWEEP, truth, "customer_id", "order_count", "is_test_account_truth"
        )
    )


@query
def quantile_profiles(c: Context) -> DataFrame:
    labelled = c.activity.join(c.sources.truth_flags(), "customer_id", "left").withColumn(
        "is_heavy", F.coalesce("is_test_account_truth", F.lit(False))
    )
    # Counts have few distinct values; a ratio may have as many as there are customers.
    parts = [
        quantile_profile(labelled, col, ["is_heavy"], cell_rows=cells).withColumn("feature", F.lit(col))
        for col, cells in (("order_count", None), ("orders_per_active_day", P.cell_rows))
    ]
    return rounded(metrics.stack(*parts))


@query
def score_flag(c: Context) -> DataFrame:
    return rounded(
        scoring.score_flag(
            c.stored["dim_customer"], c.sources.truth_flags(), "customer_id",
            "is_test_account", "is_test_account_truth",
        )
    )


@query
def duplicate_share(c: Context) -> DataFrame:
    return rounded(metrics.duplicate_share(c.raw["raw_order_events"], ["order_id", "event_type"]))


@query
def day_shift_share(c: Context) -> DataFrame:
    return rounded(
        metrics.day_shift_share(c.stored["stg_orders"], "ordered_at_utc", P.reporting_tz)
    )


# --- grain -----------------------------------------------------------------
@query
def grain_summary(c: Context) -> DataFrame:
    return rounded(G.grain_summary(c.clean_orders))


@query
def grain_summary_unflagged(c: Context) -> DataFrame:
    """The headline by the written contract: without the flagged accounts."""
    return rounded(G.grain_summary(reports.headline_orders(c.stored, exclude_flagged=True)))


@query
def grain_by_store(c: Context) -> DataFrame:
    return rounded(G.grain_summary(c.clean_orders, ["darkstore_id"]))


@query
def grain_by_band(c: Context) -> DataFrame:
    return rounded(G.grain_by_band(c.clean_orders))


@query
def fill_by_day(c: Context) -> DataFrame:
    return rounded(G.fill_by_day(c.stored["fct_orders"]))


@query
def identity_gap(c: Context) -> DataFrame:
    return rounded(G.identity_gap(c.clean_orders))


@query
def fill_curve(c: Context) -> DataFrame:
    miss = G.grain_summary(c.clean_orders, ["darkstore_id"]).select(
        "darkstore_id", "item_miss_rate"
    )
    return rounded(G.fill_curve(miss, CURVE_MAX))


@query
def required_miss(c: Context) -> DataFrame:
    """What each basket size that occurs would need for the fill target."""
    orders = E.population(c.narrow()["fct_orders"], not_cancelled=True)
    sizes = orders.groupBy("n_items").agg(F.count(F.lit(1)).alias("orders"))
    return rounded(G.required_fill(sizes, FILL_TARGET))


# --- effects ---------------------------------------------------------------
@query
def effect_pooled(c: Context) -> DataFrame:
    return rounded(E.effect(c.focal, "repeated", "had_stockout"))


@query
def effect_by_tenure(c: Context) -> DataFrame:
    return rounded(
        E.effect(c.focal, "repeated", "had_stockout", ["tenure"], [[], ["tenure"]])
    )


@query
def effect_by_segment(c: Context) -> DataFrame:
    sets = [[], ["segment"], ["tenure"], ["segment", "tenure"]]
    return rounded(
        E.effect(c.focal, "repeated", "had_stockout", ["segment", "tenure"], sets)
    )


@query
def repeat_rates(c: Context) -> DataFrame:
    return rounded(E.rate_table(c.focal, "repeated", ["segment", "had_stockout"]))


@query
def quantile_buckets(c: Context) -> DataFrame:
    return E.basket_strata(c.focal).groupBy("basket_q").agg(
        F.count(F.lit(1)).alias("orders"), F.min("n_items").alias("smallest"),
        F.max("n_items").alias("largest"),
    )


@query
def quantile_buckets_by_segment(c: Context) -> DataFrame:
    cut = quantile_bucket(c.focal, "n_items", 4, "bucket", ["segment"])
    return cut.groupBy("segment", "bucket").agg(
        F.count(F.lit(1)).alias("orders"), F.min("n_items").alias("smallest"),
        F.max("n_items").alias("largest"),
    )


def _order_values(c: Context) -> DataFrame:
    value = F.round("gross_value_aed", 2).alias("value_aed")
    return c.clean_orders.select("order_id", "darkstore_id", value)


@query
def value_buckets(c: Context) -> DataFrame:
    """Tenths of a continuous column, by selection over cells."""
    cut = quantile_bucket(_order_values(c), "value_aed", 10, "bucket", cell_rows=P.cell_rows)
    return cut.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("orders"), F.min("value_aed").alias("smallest"),
        F.max("value_aed").alias("largest"),
    )


@query
def value_profile_by_store(c: Context) -> DataFrame:
    return rounded(quantile_profile(_order_values(c), "value_aed", ["darkstore_id"], cell_rows=P.cell_rows))


@query
def value_outliers(c: Context) -> DataFrame:
    flagged = outliers.mad_outliers(_order_values(c), "order_id", "value_aed", 3.0, cell_rows=P.cell_rows)
    return rounded(flagged.groupBy("med", "mad").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("is_outlier").alias("outliers")
    ))


@query
def stratified_effect(c: Context) -> DataFrame:
    strata = E.basket_strata(c.focal)
    return rounded(E.stratified_effect(strata, "repeated", "had_stockout", "basket_q"))


@query
def exposure_gradient(c: Context) -> DataFrame:
    strata = E.basket_strata(c.focal)
    return rounded(
        E.exposure_gradient(strata, "basket_q", "n_items", "had_stockout", "repeated")
    )


@query
def high_intent_effect(c: Context) -> DataFrame:
    exposed = E.population(c.focal, exposed=True)
    return rounded(E.effect(exposed, "repeated", "had_high_intent_stockout"))


@query
def offer_arms(c: Context) -> DataFrame:
    return rounded(E.rate_table(c.exposed, "repeated", ["offer_arm"]))


@query
def arm_contrast_by_segment(c: Context) -> DataFrame:
    """Accepted against declined offers, per segment."""
    return rounded(
        E.contrast(c.exposed, "offer_arm", "accepted", "declined", "repeated", ["segment"])
    )


@query
def proxy_contrasts(c: Context) -> DataFrame:
    return rounded(E.proxy_estimates(c.exposed_cells, P.min_cell, "weight"))


@query
def proxy_spread(c: Context) -> DataFrame:
    return rounded(E.proxy_spread(E.proxy_estimates(c.exposed_cells, P.min_cell, "weight")))


def _by_type(c: Context) -> DataFrame:
    return E.substitution_contrasts(c.exposed_cells, P.min_cell, "weight")


@query
def contrast_by_type(c: Context) -> DataFrame:
    return rounded(E.ci_verdict(_by_type(c)))


@query
def rank_effects(c: Context) -> DataFrame:
    ranked = E.rank_effects(_by_type(c), "control", "substitution_type")
    return rounded(ranked.select("control", "substitution_type", "effect_pp", "rank"))


@query
def ranking_stability(c: Context) -> DataFrame:
    return E.ranking_stability(_by_type(c), "control", "substitution_type")


def _by_tenure(c: Context) -> DataFrame:
    return E.effect(c.focal, "repeated", "had_stockout", ["tenure"])


@query
def break_even(c: Context) -> DataFrame:
    wanted = ("lost_per_month", "value_month", "value_year", "value_year_realistic",
              "value_month_2sig", "value_year_2sig", "value_year_realistic_2sig")
    return rounded(E.break_even(_by_tenure(c)).select("tenure", *wanted), 4)


@query
def effect_ratio(c: Context) -> DataFrame:
    return rounded(E.effect_ratio(_by_tenure(c), "tenure", "new", "established"))


@query
def orders_lost(c: Context) -> DataFrame:
    """Per tenure, at the observed order fill rate of all orders."""
    fill = G.grain_summary(c.clean_orders).select("order_fill")
    lost = E.orders_lost(J.with_scalars(_by_tenure(c), fill), "order_fill")
    return rounded(lost.select("tenure", "order_fill", "broken_orders", "orders_lost"), 4)


# --- statistics and the experiment -----------------------------------------
@query
def srm_counts_chi2(c: Context) -> DataFrame:
    wide = c.arms
    both = metrics.stack(*[X.srm(wide, s, 0.5, P.srm_threshold) for s in ("assigned", "checkout")])
    return rounded(both.drop("p_value"))


@query
def srm_by_week(c: Context) -> DataFrame:
    """Split of the event experiment, week by week."""
    tested = stats.srm_check(c.sources.event_experiment(), "variant", by=["week"])
    return rounded(tested.drop("p_value"))


@query
def crosstab2(c: Context) -> DataFrame:
    return stats.crosstab2(c.sources.event_experiment(), "variant", "converted", ["week"])


@query
def chi2_2x2(c: Context) -> DataFrame:
    tested = stats.chi2_2x2(c.sources.event_experiment(), "variant", "converted", ["week"])
    return rounded(tested.drop("p_value"), chi2=4, welch_t=4, df=4)


@query
def welch_t_stat(c: Context) -> DataFrame:
    return rounded(X.selection_evidence(c.arms).drop("p_value"), welch_t=4, df=4)


@query
def welch_t_events(c: Context) -> DataFrame:
    tested = stats.welch_t(c.sources.event_experiment(), "value", "variant", by=["week"])
    return rounded(tested.drop("p_value"), chi2=4, welch_t=4, df=4)


@query
def spearman_rho(c: Context) -> DataFrame:
    bands = G.grain_by_band(c.clean_orders)
    parts = [
        stats.spearman(bands, "ord", rate).withColumn("rate", F.lit(rate))
        for rate in ("item_fill_macro", "order_fill")
    ]
    return rounded(metrics.stack(*parts).drop("p_value"))


@query
def spearman_customers(c: Context) -> DataFrame:
    """Rank correlation over all customers, with very many ties."""
    found = stats.spearman(c.activity, "order_count", "orders_per_active_day", cell_rows=P.cell_rows)
    return rounded(found.drop("p_value"))


@query
def mde(c: Context) -> DataFrame:
    return rounded(X.power(c.arms))


@query
def conversion_effect(c: Context) -> DataFrame:
    return rounded(X.conversion_effect(c.arms).drop("p_value"), chi2=4)


@query
def conversion_by_week(c: Context) -> DataFrame:
    counted = X.arm_statistics(c.sources.event_experiment(), "variant", by=["week"])
    wide = X.side_by_side(counted, "variant", "control", "treatment", ["week"])
    return rounded(X.conversion_effect(wide, ["week"]).drop("p_value"), chi2=4)


@query
def itt_readout(c: Context) -> DataFrame:
    return rounded(X.readout(c.arms, "assigned").drop("p_value"), chi2=4)


@query
def exposed_readout(c: Context) -> DataFrame:
    return rounded(X.readout(c.arms, "exposed").drop("p_value"), chi2=4)


def _comparable(report: DataFrame) -> DataFrame:
    """The rows that SQL can state: all but the p-values, whose tails tests cover."""
    shown = report.filter("metric NOT LIKE '%p_value' AND metric NOT LIKE '%basket_p'")
    return rounded(shown, 4).withColumnRenamed("by", "group_by")


@query
def experiment_report(c: Context) -> DataFrame:
    """Split, power, conversion, selection and both read-outs."""
    return _comparable(reports.experiment_report(c.frame, P))


@query
def analysis_report(c: Context) -> DataFrame:
    """All four read-outs of the warehouse, stored as JSON lines and read back."""
    path = c.fresh("analysis_report")
    tables.write_metrics(reports.analysis_report(c.narrow(REPORT_COLUMNS), P), path)
    return _comparable(tables.read_metrics(c.spark, path))


# --- contracted metrics ----------------------------------------------------
@query
def business_metrics(c: Context) -> DataFrame:
    return rounded(metrics.contracted_metrics(list(metrics.METRICS), c.stored))


@query
def business_metrics_by_store(c: Context) -> DataFrame:
    per_store = [n for n, m in metrics.METRICS.items() if m.table != "fct_sessions"]
    return rounded(metrics.contracted_metrics(per_store, c.stored, ["darkstore_id"]))


@query
def substitution_by_type(c: Context) -> DataFrame:
    return rounded(metrics.substitution_by_type(c.stored["fct_orders"]))


@query
def provisional_days(c: Context) -> DataFrame:
    return rounded(metrics.provisional_days(c.stored["fct_orders"], days=2))


@query
def store_age(c: Context) -> DataFrame:
    """Fill by age of the store at order time, in years."""
    years = F.floor(F.col("store_age_days_at_order") / 365).alias("store_years")
    return rounded(G.grain_summary(c.clean_orders.withColumn("store_years", years),
                                   ["store_years"]))


# --- checks and scoring ----------------------------------------------------
@query
def quality_checks(c: Context) -> DataFrame:
    return checks.run_checks(c.stored.build(), P.retention_window_days)


def _spoiled(
    df: DataFrame, id_col: str, change: dict[str, Column], repeat: int, key: str, lose: int
) -> DataFrame:
    """Changed rows, and unchanged copies of some and others without their key."""
    number = F.col(id_col)
    lost = df.filter(number % lose == 0).withColumn(key, F.lit(None).cast(df.schema[key].dataType))
    return df.withColumns(change).unionByName(df.filter(number % repeat == 0)).unionByName(lost)


@query
def quality_checks_broken(c: Context) -> DataFrame:
    """The same checks on marts in which every one of them must find something."""
    w, order = c.narrow(CHECKED_COLUMNS), F.col("order_id")

    def lose(column: str, every: int) -> Column:
        return F.when(order % every != 0, F.col(column))

    def strange(column: str, of: str, value: str) -> Column:
        return F.when(F.col(of) % 3 == 0, F.lit(value)).otherwise(F.col(column))

    unknown = F.when(order % 13 == 0, -1 - F.col("customer_id") % 5).otherwise(F.col("customer_id"))
    orders = {
        "customer_id": F.when(order % 11 != 0, unknown),
        "darkstore_key": lose("darkstore_key", 17),
        "n_items": lose("n_items", 19),
        "item_fill_rate": F.when(order % 23 == 0, 2.0).otherwise(F.col("item_fill_rate")),
        "is_clean_order": F.col("is_clean_order") | (F.dayofmonth("order_date_gst") == 3),
    }
    repeats = {
        "tenure": strange("tenure", "order_id", "old"), "is_observable_30d": F.lit(True)}
    lines = {"product_key": lose("product_key", 11), "category": lose("category", 13)}
    broken = {
        "fct_orders": _spoiled(w["fct_orders"], "order_id", orders, 7, "order_id", 29),
        "fct_customer_orders": _spoiled(
            w["fct_customer_orders"], "order_id", repeats, 7, "order_id", 29),
        "fct_sessions": _spoiled(
            w["fct_sessions"], "session_id",
            {"variant": strange("variant", "session_id", "x")}, 7, "session_id", 29),
        "dim_product": _spoiled(w["dim_product"], "product_id", {}, 5, "product_key", 31),
        "dim_darkstore": _spoiled(w["dim_darkstore"], "darkstore_id", {}, 5, "darkstore_key", 7),
        "dim_customer": _spoiled(
            w["dim_customer"], "customer_id", {"is_test_account": F.lit(False)}, 9,
            "customer_key", 10).withColumn("is_test_account", F.lit(False)),
        "fct_order_items": w["fct_order_items"].withColumns(lines),
    }
    return checks.run_checks(broken, P.retention_window_days)


def _tenure_truth(c: Context) -> DataFrame:
    return c.spark.createDataFrame(list(TRUE_EFFECTS.items()), "tenure string, true_pp double")


def _swap_truth(c: Context) -> DataFrame:
    return c.spark.createDataFrame(
        list(TRUE_REPAIR.items()), "substitution_type string, repair double"
    )


@query
def within_tolerance(c: Context) -> DataFrame:
    return rounded(
        scoring.within_tolerance(_by_tenure(c), _tenure_truth(c), "tenure", "true_pp")
    )


@query
def rank_matches(c: Context) -> DataFrame:
    typed = _by_type(c).filter(F.col("control") == "B_vs_not_offered")
    return rounded(
        scoring.rank_matches(typed, _swap_truth(c), "substitution_type", "effect_pp", "repair")
    )


@query
def rank_matches_customers(c: Context) -> DataFrame:
    """Every customer ranked by orders per active day and by orders."""
    rate, count = (c.activity.select("customer_id", n) for n in ("orders_per_active_day", "order_count"))
    return rounded(scoring.rank_matches(
        rate, count, "customer_id", "orders_per_active_day", "order_count", P.cell_rows
    ))


@query
def covers_zero(c: Context) -> DataFrame:
    shown = X.readout(c.arms, "exposed").select("population", "effect_pp", "ci_lo", "ci_hi")
    return rounded(scoring.covers(shown, 0.0))


@query
def itt_readout_bucketed(c: Context) -> DataFrame:
    """The read-out at assignment from facts in buckets by order."""
    w = c.stored
    facts = [
        tables.write_bucketed(w[name].select("order_id", *columns), c.fresh(name), "order_id", 8)
        for name, columns in (
            ("fct_orders", ["n_items"]),
            ("fct_customer_orders", ["repeat_within_30d", "is_observable_30d"]),
        )
    ]
    frame = X.experiment_frame(w["fct_sessions"], *facts, bucketed=True)
    arms = X.side_by_side(X.arm_statistics(frame, "variant", "n_items"), "variant", "control", "treatment")
    return rounded(X.readout(arms, "assigned").drop("p_value"), chi2=4)


def _srm(c: Context, stage: str) -> DataFrame:
    return X.srm(c.arms, stage, 0.5, P.srm_threshold)


@query
def srm_consistency(c: Context) -> DataFrame:
    return scoring.srm_consistency(_srm(c, "assigned"), _srm(c, "checkout"))


@query
def scorecard(c: Context) -> DataFrame:
    path = c.fresh("scorecard")
    return score_run(c.stored, _tenure_truth(c), _swap_truth(c), path)


def _fill_metrics(orders: DataFrame) -> DataFrame:
    by_store = G.grain_summary(orders, ["darkstore_id"])
    return metrics.metric_rows(
        by_store, "grain", {n: n for n in ("orders", "order_fill")}, F.col("darkstore_id")
    )


@query
def metrics_drift(c: Context) -> DataFrame:
    """What leaving out the flagged accounts changes, metric by metric."""
    flagged = c.stored["dim_customer"].filter("is_test_account").select("customer_id")
    old = rounded(_fill_metrics(c.clean_orders))
    new = rounded(_fill_metrics(J.drop_keys(c.clean_orders, flagged, ["customer_id"])))
    return rounded(metrics.metrics_drift(old, new)).withColumnRenamed("by", "group_by")


# --- public surface --------------------------------------------------------
_contexts: dict[tuple[str, str], Context] = {}


def folder_state(spark: SparkSession, folder: str) -> str:
    """A digest of the names, sizes and times of all files below a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


def context(spark: SparkSession, folder: str) -> Context:
    """One context per application and state of a folder, so stored tables are shared; a
    folder whose files have changed gets new ones."""
    key = (spark.sparkContext.applicationId, folder_state(spark, folder))
    if key not in _contexts:
        _contexts[key] = Context(configure(spark), folder, key[1])
    return _contexts[key]


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable[[Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(context(spark, folder))

    return {name: bind(fn) for name, fn in REGISTRY.items()}
