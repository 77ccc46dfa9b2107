"""Queries that need few columns of the facts: the same rows without the whole tables."""

import datetime as dt
import os

import pytest

from orderlens.registry.queries import REGISTRY, Context

FACTS = ("fct_order_items", "fct_orders", "fct_customer_orders", "fct_sessions")


def write_tables(spark, folder):
    """Few customers with many orders; keys that repeat, have no match or are missing."""
    def at(n):
        return dt.datetime(1998, 1, 1) + dt.timedelta(days=n * 7 % 200)

    orders = [(k, k % 12 + 1, "O", 10.0, at(k), "1-URGENT") for k in range(1, 241)]
    orders += orders[5:8] + [(None, 3, "O", 1.0, at(9), "1-URGENT"), (241, None, "O", 1.0, at(9), "1-URGENT")]
    lines = [(o[0], (o[0] + n) % 40 + 1, 1, n, float(n), 1.0) for o in orders[:235] for n in range(o[0] % 5 + 1)]
    lines += [(7, None, 1, 9, 2.0, 1.0), (None, 4, 1, 1, 1.0, 1.0), *lines[:4]]
    kinds = ("ECONOMY", "PROMO", "STANDARD")
    made = {
        "customer": ([(c, "Customer", c % 5, 1.0, ("BUILDING", "MACHINERY")[c % 2]) for c in (*range(1, 12), 4)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(p, kinds[p % 3], float(p)) for p in (*range(1, 39), 3)],
                 "p_partkey long, p_type string, p_retailprice double"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                           "o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                            "l_quantity double, l_extendedprice double"),
        "nation": ([(n, f"N{n}", 0) for n in range(5)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("source")))


class Whole(Context):
    """What the narrow tables stand for."""

    def narrow(self, columns=None):
        return self.stored


@pytest.fixture(scope="module")
def whole(spark, folder):
    return Whole(spark, folder, "narrow-test-whole")


def listed(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [
    "conversion_effect", "srm_counts_chi2", "exposed_readout", "itt_readout", "welch_t_stat",
    "sessions_fact",
    "analysis_report",
    "quality_checks_broken",
    "customer_sequence_lookback",
    "required_miss",
    "proxy_contrasts", "proxy_spread",
])
def test_query_stores_no_whole_fact(spark, folder, whole, name):
    c = Context(spark, folder, f"narrow-test-{name}")
    got = listed(REGISTRY[name](c))
    assert got
    stored = os.listdir(f"{c.root}/tables".removeprefix("file:"))
    assert not set(stored) & set(FACTS)
    assert got == listed(REGISTRY[name](whole))
