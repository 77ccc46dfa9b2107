"""The warehouse: raw tables -> staging -> marts, lazily or as written tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators import staging
from orderlens.operators.outliers import customer_activity, detect_test_accounts
from orderlens.operators.scd2 import most_versions
from orderlens.operators.timeline import hot_limit
from orderlens.params import Params
from orderlens.plans import marts
from orderlens.sources.tables import write_bucketed, write_fact, write_table

MARTS = (
    "dim_product",
    "dim_darkstore",
    "dim_customer",
    "dim_date",
    "fct_order_items",
    "fct_orders",
    "fct_customer_orders",
    "fct_sessions",
)
DIMENSIONS = tuple(name for name in MARTS if name.startswith("dim_"))
# Read several times, so stored once when the build is materialised.
SHARED = ("stg_orders", "int_customer_activity")
# Partition date and file order of the facts in the partitioned layout.
LAYOUT = {
    "fct_order_items": ("order_date_gst", ("darkstore_id",)),
    "fct_orders": ("order_date_gst", ("darkstore_key",)),
    "fct_customer_orders": ("order_date_gst", ("darkstore_id",)),
    "fct_sessions": ("session_date_gst", ()),
}
# Tables with one row, or a few, for each order.
BY_ORDER = ("stg_orders", "fct_order_items", "fct_orders", "fct_customer_orders")


class Warehouse:
    """Every table of the model by name.

    Without a ``root`` each table is a lazy plan and Catalyst prunes across
    layers. With a ``root`` (a folder all executors can reach) the marts and the
    shared tables are written as parquet on first use and read back, so several
    consumers share one computation and lost executors cost at most one stage.
    ``partitioned`` lays the facts out by date; choose it when a day's files are
    large enough to stand alone. ``buckets`` deals the tables by order to that many
    buckets, so that joins and checks by order need no exchange; choose it when a bucket
    of the largest of them fits a task. Only one of the two applies to a table.
    """

    def __init__(
        self,
        spark: SparkSession,
        raw: Mapping[str, DataFrame],
        params: Params | None = None,
        root: str | None = None,
        partitioned: bool = False,
        buckets: int | None = None,
    ):
        self.spark = spark
        self.raw = raw
        self.params = params or Params()
        self.root = root
        self.partitioned = partitioned
        self.buckets = buckets
        self._tables: dict[str, DataFrame] = {}
        self._whole: Warehouse | None = None
        self._columns: Mapping[str, Sequence[str]] = {}

    def narrow(self, root: str, columns: Mapping[str, Sequence[str]]) -> Warehouse:
        """The same model for read-outs that need few columns of the facts.

        Shared tables and dimensions are those of this warehouse. A fact in ``columns``, for
        one that is read several times, is stored under ``root`` with those columns only; the
        tables built on it lack the others. All other facts stay lazy plans, so that what
        nobody asks for is not computed, moved or written. The rows are the same.
        """
        made = Warehouse(self.spark, self.raw, self.params, root)
        made._whole, made._columns = self, columns
        return made

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            make = getattr(self, f"_{name}", None)
            if make is None:
                raise KeyError(f"no table {name}")
            self._tables[name] = self._made(name, make)
        return self._tables[name]

    def _made(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if self._whole is not None:
            if name in SHARED + DIMENSIONS:
                return self._whole[name]
            if name not in self._columns:
                return make()
            return self._store(name, make().select(*self._columns[name]))
        df = make()
        return self._store(name, df) if self.root and name in MARTS + SHARED else df

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        if self.buckets and name in BY_ORDER:
            return write_bucketed(df, path, "order_id", self.buckets)
        if not (self.partitioned and name in LAYOUT):
            return write_table(df, path)
        date, order = LAYOUT[name]
        write_fact(df, path, date, order)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def build(self) -> dict[str, DataFrame]:
        """All marts."""
        return {name: self[name] for name in MARTS}

    def register_views(self) -> None:
        """Expose every staging, intermediate and mart table to SQL."""
        staged = [n[1:] for n in dir(type(self)) if n.startswith(("_stg_", "_int_"))]
        for name in [*staged, *MARTS]:
            self[name].createOrReplaceTempView(name)

    # --- staging -----------------------------------------------------------
    def _stg_orders(self) -> DataFrame:
        return staging.stage_orders(self.raw["raw_order_events"], self.params)

    def _stg_order_items(self) -> DataFrame:
        return staging.stage_order_items(self.raw["raw_order_items"])

    def _stg_fulfilment(self) -> DataFrame:
        return staging.stage_fulfilment(self.raw["raw_fulfilment_events"], self.params)

    def _stg_sessions(self) -> DataFrame:
        return staging.stage_sessions(self.raw["raw_sessions"], self.params)

    def _stg_experiment_assignments(self) -> DataFrame:
        return staging.stage_assignments(self.raw["raw_experiment_assignments"], self.params)

    def _stg_customers(self) -> DataFrame:
        return staging.stage_customers(self.raw["raw_customers"])

    def _stg_products(self) -> DataFrame:
        return staging.stage_products(self.raw["raw_products"], self.params)

    def _stg_darkstores(self) -> DataFrame:
        return staging.stage_darkstores(self.raw["raw_darkstores"])

    # --- intermediate ------------------------------------------------------
    def _int_customer_activity(self) -> DataFrame:
        return customer_activity(self["stg_orders"])

    def _int_test_accounts(self) -> DataFrame:
        return detect_test_accounts(self["int_customer_activity"], self.params.mad_k)

    def _int_customer_order_sequence(self) -> DataFrame:
        orders, p = self["stg_orders"], self.params
        if self.root:
            activity = self["int_customer_activity"]
            p = replace(p, hot_rows=hot_limit(activity, "order_count", p.hot_rows))
        return marts.customer_order_sequence(orders, p)

    # --- marts -------------------------------------------------------------
    def _dim_product(self) -> DataFrame:
        return marts.dim_product(self["stg_products"])

    def _dim_darkstore(self) -> DataFrame:
        return marts.dim_darkstore(self["stg_darkstores"])

    def _dim_customer(self) -> DataFrame:
        return marts.dim_customer(self["stg_customers"], self["int_test_accounts"])

    def _dim_date(self) -> DataFrame:
        p, orders = self.params, self["stg_orders"]
        first, last = orders.agg(F.min("order_date_gst"), F.max("order_date_gst")).first()
        if first is None and not (p.calendar_start and p.calendar_end):
            return marts.calendar(self.spark, "1970-01-01", "1970-01-02").limit(0)
        start = p.calendar_start or str(first)
        return marts.calendar(self.spark, start, p.calendar_end or str(last + timedelta(days=1)))

    def _carries(self, dim: str, key: str) -> bool:
        """Whether a key of a stored dimension has so many versions that a join carries them."""
        return bool(self.root) and most_versions(self[dim], key) > self.params.many_versions

    def _fct_order_items(self) -> DataFrame:
        return marts.fct_order_items(
            self["stg_order_items"],
            self["stg_orders"],
            self["dim_product"],
            self.params,
            self._carries("dim_product", "product_id"),
        )

    def _fct_orders(self) -> DataFrame:
        return marts.fct_orders(
            self["fct_order_items"],
            self["stg_orders"],
            self["stg_fulfilment"],
            self["dim_darkstore"],
            self._carries("dim_darkstore", "darkstore_id"),
        )

    def _fct_customer_orders(self) -> DataFrame:
        return marts.fct_customer_orders(
            self["int_customer_order_sequence"],
            self["stg_orders"],
            self["fct_orders"],
            self["dim_customer"],
            self.params,
        )

    def _fct_sessions(self) -> DataFrame:
        return marts.fct_sessions(
            self["stg_sessions"],
            self["stg_experiment_assignments"],
            self["fct_orders"],
            self["dim_customer"],
        )
