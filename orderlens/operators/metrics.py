"""Business metrics by contract, event-log profiles, and drift between outputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import local_date, outcome_bool, safe_ratio
from orderlens.operators.effects import population
from orderlens.operators.joins import with_totals

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Metric:
    """A ratio over one table: numerator and denominator of the rows in scope.

    A value expression sums; without one, rows are counted.
    """

    table: str
    scope: Callable[[], Column]
    hit: Callable[[], Column] | None = None
    value: str | None = None

    def numerator(self) -> Column:
        if self.value:
            return F.sum(F.when(self.scope(), F.col(self.value)))
        return F.count_if(self.scope() & self.hit())

    def denominator(self) -> Column:
        return F.count_if(self.scope())


def _kept() -> Column:
    return ~F.col("is_cancelled")


METRICS = {
    "item_fill_rate": Metric(
        "fct_order_items", lambda: F.lit(True), lambda: ~F.col("was_stocked_out")
    ),
    "order_fill_rate": Metric("fct_orders", _kept, lambda: F.col("is_clean_order")),
    "repeat_rate_30d": Metric(
        "fct_customer_orders",
        lambda: F.col("is_observable_30d") & ~F.coalesce("is_test_account", F.lit(False)),
        lambda: outcome_bool(F.col("repeat_within_30d")),
    ),
    "conversion_rate": Metric("fct_sessions", lambda: F.lit(True), lambda: F.col("converted")),
    "substitution_rate": Metric(
        "fct_orders", lambda: _kept() & F.col("had_stockout"), lambda: F.col("substitute_offered")
    ),
    "high_intent_stockout_rate": Metric(
        "fct_orders", _kept, lambda: F.col("had_high_intent_stockout")
    ),
    "ingestion_lag_minutes": Metric(
        "fct_orders",
        lambda: F.col("ingestion_lag_minutes").isNotNull(),
        value="ingestion_lag_minutes",
    ),
    "late_share": Metric(
        "fct_orders",
        lambda: F.col("is_late_arriving").isNotNull(),
        lambda: F.col("is_late_arriving"),
    ),
}


def contracted_metrics(
    names: Sequence[str], tables: Tables, by: Sequence[str] = ()
) -> DataFrame:
    """by..., metric, value, numerator, denominator; one scan per source table."""
    parts = []
    for table in dict.fromkeys(METRICS[n].table for n in names):
        own = [n for n in names if METRICS[n].table == table]
        sums = tables[table].groupBy(*by).agg(
            *[METRICS[n].numerator().alias(f"_n_{n}") for n in own],
            *[METRICS[n].denominator().alias(f"_d_{n}") for n in own],
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(n).alias("metric"),
                    F.col(f"_n_{n}").alias("numerator"),
                    F.col(f"_d_{n}").alias("denominator"),
                )
                for n in own
            ]
        )
        parts.append(sums.select(*by, F.inline(rows)))
    value = safe_ratio(F.col("numerator"), F.col("denominator")).alias("value")
    return stack(*parts).select(*by, "metric", value, "numerator", "denominator")


def metric(name: str, tables: Tables, by: Sequence[str] = ()) -> DataFrame:
    """by..., value, numerator, denominator of one contracted metric."""
    return contracted_metrics([name], tables, by).drop("metric")


def substitution_by_type(orders: DataFrame) -> DataFrame:
    """Stocked-out orders per offered swap type, and their share of all of them."""
    rows = population(orders, not_cancelled=True, exposed=True)
    kind = F.when(F.col("substitute_offered"), F.col("substitution_type"))
    counted = rows.groupBy(kind.alias("substitution_type")).agg(F.count(F.lit(1)).alias("n"))
    placed = with_totals(counted, _total=F.sum("n"))
    return placed.select("substitution_type", "n", safe_ratio(F.col("n"), F.col("_total")).alias("value"))


def provisional_days(orders: DataFrame, date: str = "order_date_gst", days: int = 1) -> DataFrame:
    """Lag and late share per day; the newest days are marked provisional."""
    daily = orders.groupBy(date).agg(
        F.avg("ingestion_lag_minutes").alias("mean_lag_minutes"),
        F.max("ingestion_lag_minutes").alias("max_lag_minutes"),
        safe_ratio(F.count_if("is_late_arriving"), F.count("is_late_arriving")).alias(
            "late_share"
        ),
    )
    dated = with_totals(daily, _newest=F.max(date))
    late = F.col(date) > F.date_sub("_newest", days)
    return dated.withColumn("is_provisional", late).drop("_newest")


def duplicate_share(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and share of repeated rows of an event log."""
    per_key = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = per_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    repeated = F.col("n_rows") - F.col("n_keys")
    return totals.withColumn("duplicate_share", safe_ratio(repeated, F.col("n_rows")))


def day_shift_share(events: DataFrame, ts: str, tz: str) -> DataFrame:
    """Share of rows whose calendar date differs between UTC and the reporting zone."""
    moved = F.col(ts).cast("date") != local_date(F.col(ts), tz)
    return events.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(moved).alias("n_moved"),
        safe_ratio(F.count_if(moved), F.count(F.lit(1))).alias("moved_share"),
    )


def stack(*parts: DataFrame) -> DataFrame:
    """Union by name; a column missing from a part is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def metric_rows(
    df: DataFrame,
    section: str,
    values: Mapping[str, str],
    by: Column | None = None,
    lo: str | None = None,
    hi: str | None = None,
    n: str | None = None,
) -> DataFrame:
    """Wide read-out -> long metric rows; ``values`` maps metric names to columns.

    The interval belongs to the first metric.
    """
    first = next(iter(values))
    none = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(col).cast("double").alias("value"),
            (F.col(lo).cast("double") if lo and name == first else none).alias("ci_lo"),
            (F.col(hi).cast("double") if hi and name == first else none).alias("ci_hi"),
        )
        for name, col in values.items()
    ]
    return df.select(
        F.lit(section).alias("section"),
        (by.cast("string") if by is not None else F.lit("all")).alias("by"),
        (F.col(n).cast("bigint") if n else F.lit(None).cast("bigint")).alias("n"),
        F.inline(F.array(*rows)),
    ).select("section", "metric", "by", "value", "ci_lo", "ci_hi", "n")


METRIC_KEY = ("section", "metric", "by")


def metrics_drift(old: DataFrame, new: DataFrame, tol: float = 0.0) -> DataFrame:
    """Metric rows that differ between two outputs; exact unless a tolerance is given."""
    a = old.select(*METRIC_KEY, F.col("value").alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(*METRIC_KEY, F.col("value").alias("new_value"), F.lit(True).alias("_b"))
    both = a.join(b, list(METRIC_KEY), "full")
    x, y = F.col("old_value"), F.col("new_value")
    far = F.coalesce(F.abs(x - y) > tol, ~x.eqNullSafe(y))
    status = (
        F.when(F.col("_b").isNull(), "removed")
        .when(F.col("_a").isNull(), "added")
        .when(far, "changed")
    )
    return (
        both.withColumn("status", status)
        .filter(F.col("status").isNotNull())
        .select(*METRIC_KEY, "old_value", "new_value", "status")
    )
