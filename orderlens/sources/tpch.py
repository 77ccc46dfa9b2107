"""The eight raw tables derived from an orders / lineitem / customer / part schema.

Every synthetic attribute is integer arithmetic on the keys, so any SQL engine
derives the same rows. ``FIXTURES.md`` holds the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators.quantiles import exact_percentiles
from orderlens.operators.scd2 import scd2_from_changes
from orderlens.params import Params

# Parameters under which this data exercises every rule (see FIXTURES.md).
TPCH_PARAMS = Params(
    retention_window_days=90,
    mad_k=2.0,
    high_intent_categories=("ECONOMY", "PROMO"),
    min_cell=5,
)
SWAP_BY_DRAW = ("same_brand_diff_size", "diff_brand_same_product", "diff_product_same_cat")


def draw(key: Column, factor: int, modulus: int) -> Column:
    """Integer hash of a key into [0, modulus)."""
    return ((key * factor) % 10007) % modulus


def swap_draw(order: Column) -> Column:
    d = draw(order, 271, 100)
    return (
        F.when(d < 34, SWAP_BY_DRAW[0]).when(d < 75, SWAP_BY_DRAW[1]).otherwise(SWAP_BY_DRAW[2])
    )


def offer_draw(order: Column) -> Column:
    return draw(order, 613, 100) < 62


def accept_draw(order: Column) -> Column:
    d = draw(order, 271, 100)
    bar = F.when(d < 34, 78).when(d < 75, 55).otherwise(29)
    return draw(order, 947, 100) < bar


def placed_at(order: Column, order_date: Column) -> Column:
    return F.timestamp_add("SECOND", order * 7919 % 86400, order_date)


class TpchSources:
    """Lazy raw tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def raw_order_events(self) -> DataFrame:
        o = F.col("o_orderkey")
        placed = placed_at(o, F.col("o_orderdate"))
        cancelled = F.timestamp_add("MINUTE", 2 + o % 23, placed)

        def event(kind: str, at: Column) -> Column:
            return F.struct(F.lit(kind).alias("event_type"), at.alias("event_at_utc"))

        def retry(at: Column) -> Column:
            return F.timestamp_add("MICROSECOND", (200 + o % 700) * 1000, at)

        is_cancelled, is_retried = o % 41 == 0, o % 83 == 0
        log = F.array_compact(
            F.array(
                event("order_placed", placed),
                F.when(is_cancelled, event("order_cancelled", cancelled)),
                F.when(is_retried, event("order_placed", retry(placed))),
                F.when(is_cancelled & is_retried, event("order_cancelled", retry(cancelled))),
            )
        )
        stores = self.table("customer").select("c_custkey", "c_nationkey")
        return (
            self.table("orders")
            .join(stores, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                o.alias("order_id"),
                F.col("o_custkey").alias("customer_id"),
                F.col("c_nationkey").cast("bigint").alias("darkstore_id"),
                F.inline(log),
            )
        )

    def raw_order_items(self) -> DataFrame:
        o = F.col("l_orderkey")
        out = (o * 31 + F.col("l_linenumber") * 17 + F.col("l_partkey") * 7) % 17 == 0
        return self.table("lineitem").select(
            o.alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            out.alias("was_stocked_out"),
            (out & offer_draw(o) & accept_draw(o)).alias("was_substituted"),
            F.when(out & offer_draw(o), swap_draw(o)).alias("substitution_type"),
        )

    def raw_fulfilment_events(self) -> DataFrame:
        o = F.col("o_orderkey")
        fulfilled = F.timestamp_add(
            "MINUTE", 8 + draw(o, 89, 26), placed_at(o, F.col("o_orderdate"))
        )
        lag = F.when(draw(o, 557, 100) < 8, 60 + draw(o, 733, 300)).otherwise(1 + draw(o, 733, 3))
        short = (
            self.raw_order_items().groupBy("order_id").agg(F.bool_or("was_stocked_out").alias("s"))
        )
        had = F.coalesce(F.col("s"), F.lit(False))
        offered = had & offer_draw(o)
        return (
            self.table("orders")
            .select("o_orderkey", "o_orderdate")
            .join(short, F.col("o_orderkey") == F.col("order_id"), "left")
            .select(
                o.alias("order_id"),
                fulfilled.alias("fulfilled_at_utc"),
                F.timestamp_add("MINUTE", lag, fulfilled).alias("ingested_at_utc"),
                had.alias("had_stockout"),
                offered.alias("substitute_offered"),
                (offered & accept_draw(o)).alias("substitute_accepted"),
                F.when(offered, swap_draw(o)).alias("substitution_type"),
            )
        )

    def product_changes(self) -> DataFrame:
        """Price change log: one row per product and effective date."""
        p = F.col("p_partkey")

        def change(day: str, price: Column) -> Column:
            return F.struct(F.lit(day).cast("date").alias("at"), price.alias("base_price_aed"))

        price = F.col("p_retailprice")
        log = F.array_compact(
            F.array(
                change("1995-01-01", price),
                F.when(p % 16 == 0, change("1998-04-01", price * 1.1)),
            )
        )
        return self.table("part").select(
            p.alias("product_id"),
            F.when(p % 33 != 0, F.col("p_type")).alias("category"),
            F.inline(log),
        )

    def raw_products(self) -> DataFrame:
        return scd2_from_changes(self.product_changes(), ["product_id"], "at").select(
            "product_id", "category", "base_price_aed", "valid_from", "valid_to", "is_current"
        )

    def raw_darkstores(self) -> DataFrame:
        n = F.col("n_nationkey").cast("bigint")
        opened = F.date_add(F.lit("1994-01-01").cast("date"), F.col("n_nationkey"))

        def change(day: Column, radius: float) -> Column:
            return F.struct(day.alias("at"), F.lit(radius).alias("catchment_radius_km"))

        log = F.array_compact(
            F.array(
                change(opened, 2.5),
                F.when(n % 3 == 0, change(F.lit("1998-06-01").cast("date"), 3.4)),
            )
        )
        changes = (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                n.alias("darkstore_id"),
                F.col("n_name").alias("darkstore_name"),
                F.col("r_name").alias("area"),
                (1 + n * 0.25).alias("affluence_index"),
                opened.alias("opened_on"),
                F.inline(log),
            )
        )
        return scd2_from_changes(changes, ["darkstore_id"], "at").select(
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

    def raw_customers(self) -> DataFrame:
        c = F.col("c_custkey")
        first = F.lit("1994-06-01").cast("date")
        return self.table("customer").select(
            c.alias("customer_id"),
            F.col("c_mktsegment").alias("segment"),
            F.date_add(first, (c % 200).cast("int")).alias("acquired_on"),
            F.col("c_nationkey").cast("bigint").alias("home_darkstore_id"),
            F.lit(False).alias("is_test_account"),
        )

    def _order_sessions(self) -> DataFrame:
        """One row per order with items, with its arm and its drop-out draw."""
        o = F.col("o_orderkey")
        size = self.table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"))
        arm = F.when(draw(o, 3361, 1000) < 500, "control").otherwise("treatment")
        dropped = draw(o, 4973, 1000) < 10 + 22 * F.col("n_items")
        return (
            self.table("orders")
            .join(size, F.col("o_orderkey") == F.col("l_orderkey"))
            .select(
                o.alias("order_key"),
                F.col("o_custkey").alias("customer_id"),
                F.timestamp_add("MINUTE", F.lit(-10), placed_at(o, F.col("o_orderdate"))).alias(
                    "at"
                ),
                arm.alias("variant"),
                ((arm == "treatment") & dropped).alias("dropped"),
            )
        )

    def raw_sessions(self) -> DataFrame:
        """The order session and one browse session of each order with items."""
        visit = F.array(
            F.struct(
                (F.col("order_key") * 2).alias("session_id"),
                (~F.col("dropped")).alias("converted"),
                F.when(~F.col("dropped"), F.col("order_key")).alias("order_id"),
                F.col("at").alias("started_at_utc"),
            ),
            F.struct(
                (F.col("order_key") * 2 + 1).alias("session_id"),
                F.lit(False).alias("converted"),
                F.lit(None).cast("bigint").alias("order_id"),
                F.timestamp_add("HOUR", F.lit(-6), F.col("at")).alias("started_at_utc"),
            ),
        )
        return self._order_sessions().select("customer_id", F.inline(visit))

    def raw_experiment_assignments(self) -> DataFrame:
        return self._order_sessions().select(
            (F.col("order_key") * 2).alias("session_id"),
            "customer_id",
            "variant",
            F.col("at").alias("assigned_at_utc"),
        )

    def event_experiment(self) -> DataFrame:
        """A second experiment, on the event table: session = event."""
        e = F.col("event_id")
        variant = F.when(draw(e, 3361, 2) == 0, "control").otherwise("treatment")
        dropped = (variant == "treatment") & (draw(e, 613, 100) < 19)
        return self.table("events").select(
            e.alias("session_id"),
            F.col("user_id").alias("customer_id"),
            F.trunc(F.col("ts").cast("date"), "week").alias("week"),
            variant.alias("variant"),
            ((F.col("event_type") == "purchase") & ~dropped).alias("converted"),
            "value",
        )

    def truth_flags(self) -> DataFrame:
        """Answer key for scoring: customers above the 98th percentile of order count."""
        counts = self.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
        bar = exact_percentiles(counts, "n", [0.98]).select(F.col("percentiles")[0]).scalar()
        return counts.select(
            F.col("o_custkey").alias("customer_id"),
            (F.col("n") > bar).alias("is_test_account_truth"),
        )

    def all(self) -> dict[str, DataFrame]:
        return {
            "raw_customers": self.raw_customers(),
            "raw_products": self.raw_products(),
            "raw_darkstores": self.raw_darkstores(),
            "raw_order_events": self.raw_order_events(),
            "raw_order_items": self.raw_order_items(),
            "raw_fulfilment_events": self.raw_fulfilment_events(),
            "raw_sessions": self.raw_sessions(),
            "raw_experiment_assignments": self.raw_experiment_assignments(),
        }
