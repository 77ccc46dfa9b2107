"""Raw source tables: schemas, manifest, CSV scan and full-refresh landing."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.columns import utc_wall_clock

# The eight source tables, their columns and their catalogue.
SCHEMAS = {
    "raw_customers": (
        "customer_id string, segment string, acquired_on date, home_darkstore_id string,"
        " is_test_account boolean"
    ),
    "raw_products": (
        "product_id string, category string, base_price_aed double, valid_from date,"
        " valid_to date, is_current boolean"
    ),
    "raw_darkstores": (
        "darkstore_id string, darkstore_name string, area string, affluence_index double,"
        " opened_on date, catchment_radius_km double, valid_from date, valid_to date,"
        " is_current boolean"
    ),
    "raw_order_events": (
        "order_id string, customer_id string, darkstore_id string, event_type string,"
        " event_at_utc timestamp_ntz"
    ),
    "raw_order_items": (
        "order_id string, product_id string, quantity int, was_stocked_out boolean,"
        " was_substituted boolean, substitution_type string"
    ),
    "raw_fulfilment_events": (
        "order_id string, fulfilled_at_utc timestamp_ntz, ingested_at_utc timestamp_ntz,"
        " had_stockout boolean, substitute_offered boolean, substitute_accepted boolean,"
        " substitution_type string"
    ),
    "raw_sessions": (
        "session_id string, customer_id string, converted boolean, order_id string,"
        " started_at_utc timestamp_ntz"
    ),
    "raw_experiment_assignments": (
        "session_id string, customer_id string, variant string, assigned_at_utc timestamp_ntz"
    ),
}
SOURCES = tuple(SCHEMAS)
CLOCK = "timestamp_ntz"

# name, grain, latency, owner
CATALOG = (
    ("raw_customers", "one row per customer", "daily", "CRM"),
    ("raw_products", "product_id + valid_from", "daily", "catalogue"),
    ("raw_darkstores", "darkstore_id + valid_from", "ad hoc", "ops"),
    ("raw_order_events", "one row per event", "real-time", "order service"),
    ("raw_order_items", "order_id + product_id", "real-time", "order service"),
    ("raw_fulfilment_events", "one row per order", "up to 6h", "warehouse ops"),
    ("raw_sessions", "one row per session", "real-time", "app analytics"),
    ("raw_experiment_assignments", "one row per session", "real-time", "experimentation"),
)

# The header must name the declared columns in their order.
CSV_OPTIONS = {"header": "true", "enforceSchema": "false"}


def source_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.csv"


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def require_sources(spark: SparkSession, folder: str, names: tuple[str, ...] = SOURCES) -> None:
    """Fail before any work when a source of the manifest is missing."""
    missing = [n for n in names if not _exists(spark, source_path(folder, n))]
    if missing:
        raise FileNotFoundError(f"missing source files in {folder}: {', '.join(missing)}")


def read_raw(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """One source as CSV with a declared schema: one scan, no inference pass.

    Timestamps may carry an offset and become UTC clocks without zone. A value or
    a header that does not fit the declaration fails the read.
    """
    if name not in SCHEMAS:
        raise KeyError(f"{name} is not a source; the sources are {', '.join(SOURCES)}")
    declared = [f.strip().split(" ", 1) for f in (schema or SCHEMAS[name]).split(",")]
    as_text = ", ".join(f"{c} {'string' if t == CLOCK else t}" for c, t in declared)
    rows = (
        spark.read.options(**CSV_OPTIONS)
        .option("mode", "FAILFAST")
        .schema(as_text)
        .csv(source_path(folder, name))
    )
    return rows.select(
        *[utc_wall_clock(F.col(c)).alias(c) if t == CLOCK else F.col(c) for c, t in declared]
    )


def write_csv(df: DataFrame, folder: str, name: str) -> None:
    """One source as CSV, clock times with their fractions."""
    clock = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    path = source_path(folder, name)
    df.write.mode("overwrite").options(header="true", **clock).csv(path)


def land_raw(
    spark: SparkSession,
    folder: str,
    target: str,
    schemas: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Full refresh of every source into parquet, defects intact.

    Only manifest names are read, so an answer key beside them is never landed.
    """
    require_sources(spark, folder)
    landed = {}
    for name in SOURCES:
        path = f"{target.rstrip('/')}/{name}"
        read_raw(spark, folder, name, (schemas or {}).get(name)).write.mode("overwrite").parquet(
            path
        )
        landed[name] = spark.read.parquet(path)
    return landed


def landing_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per landed table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def source_catalog(spark: SparkSession, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Owner, grain and latency of each source, with row counts when tables are given."""
    catalog = spark.createDataFrame(
        list(CATALOG), "table_name string, grain string, latency string, owner string"
    )
    if tables is None:
        return catalog
    return catalog.join(landing_counts(tables), "table_name", "left")
