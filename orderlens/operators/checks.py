"""Data-quality checks. Each returns the violating rows; empty means passed.

A check that has to look at a whole group counts per key first, so a hot key is
one row before it meets its parent or its twin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import safe_ratio
from orderlens.operators.scd2 import check_no_overlap
from orderlens.session import keep


def null_in(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def outside(col: str, values: Sequence[str]) -> Column:
    """A value that is not in the list; NULL is not a value."""
    return ~F.col(col).isin(*values)


def beyond(col: str, lo: float, hi: float) -> Column:
    return (F.col(col) < lo) | (F.col(col) > hi)


def check_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > 1)


def check_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(null_in(cols))


def check_accepted(
    df: DataFrame, col: str, values: Sequence[str], where: Column | None = None
) -> DataFrame:
    """Values outside a list; NULL is not a value."""
    scope = df if where is None else df.filter(where)
    return scope.filter(outside(col, values))


def check_relationship(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Foreign keys without a parent, with the number of child rows of each."""
    used = child.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n"))
    return used.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def check_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.filter(beyond(col, lo, hi))


def check_any(df: DataFrame, col: str) -> DataFrame:
    """One row when no row carries the flag: the detector has gone silent."""
    seen = df.agg(F.count_if(col).alias("n_flagged"))
    return seen.filter(F.col("n_flagged") == 0)


def check_fill_order(df: DataFrame, by: Sequence[str], slack: float = 1e-9) -> DataFrame:
    """Groups whose order fill exceeds their macro item fill."""
    rates = df.groupBy(*by).agg(
        F.avg("item_fill_rate").alias("item_fill_macro"),
        safe_ratio(F.count_if("is_clean_order"), F.count(F.lit(1))).alias("order_fill"),
    )
    return rates.filter(F.col("order_fill") > F.col("item_fill_macro") + slack)


def check_not_censored(
    df: DataFrame, date: str, flag: str, window: int, bounds: DataFrame | None = None
) -> DataFrame:
    """Rows called observable although their outcome window is not over."""
    source = df if bounds is None else bounds
    newest = source.agg(F.max(date)).scalar()
    return df.filter(F.col(flag) & (F.col(date) > F.date_sub(newest, window)))


def check_version_found(df: DataFrame, key: str) -> DataFrame:
    """Fact rows for which no dimension version was live."""
    return df.filter(null_in([key]))


def _result(check: str, table: str, column: str, violations: DataFrame) -> DataFrame:
    counted = violations.agg(F.count(F.lit(1)).alias("n_violations"))
    return counted.select(
        F.lit(check).alias("check"),
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        "n_violations",
        (F.col("n_violations") == 0).alias("passed"),
    )


# The declared column tests of the marts.
UNIQUE = (
    ("fct_orders", "order_id"),
    ("dim_product", "product_key"),
    ("dim_darkstore", "darkstore_key"),
    ("dim_customer", "customer_key"),
    ("fct_customer_orders", "order_id"),
    ("fct_sessions", "session_id"),
)
NOT_NULL = (
    *UNIQUE,
    ("fct_orders", "customer_id"),
    ("fct_orders", "darkstore_key"),
    ("fct_orders", "n_items"),
    ("fct_order_items", "product_key"),
    ("fct_order_items", "category"),
)
ACCEPTED = (
    ("fct_customer_orders", "tenure", ("new", "established")),
    ("fct_sessions", "variant", ("control", "treatment")),
)


RELATIONSHIPS = (("fct_orders", "customer_id", "dim_customer", "customer_id"),)

Result = tuple[str, str, str, Column]  # check, table, column, number of violations


def _inline(one_row: DataFrame, found: Sequence[Result]) -> DataFrame:
    """One row per check from a single row of counts."""
    rows = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            n.cast("bigint").alias("n_violations"),
            (n == 0).alias("passed"),
        )
        for check, table, column, n in found
    ]
    return one_row.select(F.inline(F.array(*rows)))


def _key_results(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Uniqueness, missing keys and relationships of all tables, through one exchange.

    Every row is expanded to the keys that some check looks at, named by the check, and
    counted per check and key before and after it travels. A relationship counts child and
    parent keys in one group, so it needs no join.
    """
    looked: dict[str, list[tuple[int, str, bool]]] = {}
    for i, (table, column) in enumerate(UNIQUE):
        looked.setdefault(table, []).append((i, column, False))
    for i, (child, fk, parent, pk) in enumerate(RELATIONSHIPS, len(UNIQUE)):
        looked.setdefault(child, []).append((i, fk, False))
        looked.setdefault(parent, []).append((i, pk, True))

    def expanded(table: str) -> DataFrame:
        keys = [
            F.struct(
                F.lit(i).alias("check"), F.col(c).cast("string").alias("key"), F.lit(p).alias("parent")
            )
            for i, c, p in looked[table]
        ]
        return tables[table].select(F.inline(F.array(*keys)))

    counts = reduce(DataFrame.unionByName, map(expanded, looked)).groupBy("check", "key").agg(
        F.count_if(~F.col("parent")).alias("n"), F.bool_or("parent").alias("known")
    )
    missing = F.col("key").isNull()
    sums, found = [], []
    for i, (table, column) in enumerate(UNIQUE):
        mine = F.col("check") == i
        sums.append(F.count_if(mine & (F.col("n") > 1)).alias(f"unique_{i}"))
        sums.append(F.coalesce(F.sum(F.when(mine & missing, F.col("n"))), F.lit(0)).alias(f"null_{i}"))
        found.append(("unique", table, column, F.col(f"unique_{i}")))
        found.append(("not_null", table, column, F.col(f"null_{i}")))
    for i, (table, column, _, _) in enumerate(RELATIONSHIPS, len(UNIQUE)):
        orphan = (F.col("check") == i) & ~missing & ~F.col("known")
        sums.append(F.count_if(orphan).alias(f"orphans_{i}"))
        found.append(("relationship", table, column, F.col(f"orphans_{i}")))
    return _inline(counts.agg(*sums), found)


def _row_results(table: str, df: DataFrame, found: Sequence[Result]) -> DataFrame:
    """All row checks of a table from one scan of it; a violation is a condition on a row."""
    counts = df.agg(*[F.count_if(bad).alias(f"_{i}") for i, (*_, bad) in enumerate(found)])
    return _inline(counts, [(c, t, col, F.col(f"_{i}")) for i, (c, t, col, _) in enumerate(found)])


def _order_days(orders: DataFrame, found: Sequence[Result]) -> DataFrame:
    """One row per date: violations of the row checks, and both fill rates; kept."""
    return keep(
        orders.groupBy("order_date_gst").agg(
            *[F.count_if(bad).alias(f"_{i}") for i, (*_, bad) in enumerate(found)],
            F.avg("item_fill_rate").alias("item_fill_macro"),
            safe_ratio(F.count_if("is_clean_order"), F.count(F.lit(1))).alias("order_fill"),
        )
    )


def run_checks(tables: Mapping[str, DataFrame], window: int) -> DataFrame:
    """Every check over the marts: one row each, with its number of violations.

    All key checks share one exchange, the checks of rows one scan of their table; a scan
    of the orders by date answers its row checks, the order of the fill rates and the newest
    date. So no table but the small catalogue is read more than twice.
    """
    rows: dict[str, list[Result]] = {}
    for table, column in NOT_NULL:
        if (table, column) not in UNIQUE:
            rows.setdefault(table, []).append(("not_null", table, column, null_in([column])))
    for table, column, values in ACCEPTED:
        rows.setdefault(table, []).append(("accepted_values", table, column, outside(column, values)))
    rows["fct_orders"].append(("range", "fct_orders", "item_fill_rate", beyond("item_fill_rate", 0, 1)))
    missing = null_in(["product_key"])
    rows["fct_order_items"].append(("version_found", "fct_order_items", "product_key", missing))

    by_row = rows.pop("fct_orders")
    days = _order_days(tables["fct_orders"], by_row)
    newest = days.agg(F.max("order_date_gst")).scalar()
    early = F.col("is_observable_30d") & (F.col("order_date_gst") > F.date_sub(newest, window))
    rows["fct_customer_orders"].append(("not_censored", "fct_customer_orders", "is_observable_30d", early))

    wrong = F.count_if(F.col("order_fill") > F.col("item_fill_macro") + 1e-9)
    sums = [F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"_{i}") for i in range(len(by_row))]
    of_days = [(c, t, col, F.col(f"_{i}")) for i, (c, t, col, _) in enumerate(by_row)]
    of_days.append(("fill_order", "fct_orders", "order_date_gst", F.col("wrong")))
    silent = check_any(tables["dim_customer"], "is_test_account")
    overlaps = check_no_overlap(tables["dim_product"], "product_id")
    results = [
        _key_results(tables),
        _inline(days.agg(*sums, wrong.alias("wrong")), of_days),
        *[_row_results(t, tables[t], found) for t, found in rows.items()],
        _result("any_flagged", "dim_customer", "is_test_account", silent),
        _result("no_overlap", "dim_product", "product_id", overlaps),
    ]
    return reduce(DataFrame.unionByName, results)
