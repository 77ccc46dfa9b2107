"""Every registered query against its SQL twin: names, types and values."""

import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from orderlens.registry.oracle import TWINS
from orderlens.registry.queries import callables

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def test_registry_and_twins_name_the_same_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    queries, twins = set(callables()), set(TWINS)
    assert twins <= queries
    assert queries == twins


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_sql_twin(spark, duck, name):
    df = callables()[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = duck.sql(TWINS[name])
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, [str(t) for t in relation.types]))
    assert kinds == {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields}
    place = [relation.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in place) for r in relation.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_reports_hold_the_probabilities_of_their_statistics(spark):
    """What the twins leave out: each p-value is the tail of the statistic beside it."""
    from orderlens.functions import tails
    from orderlens.plans import reports
    from orderlens.registry.queries import P, context

    c = context(spark, FOLDER)
    found = {(r.section, r.metric): r.value for r in reports.experiment_report(c.frame, P).collect()}
    for section in ("srm_assigned", "srm_checkout"):
        want = tails.chi2_tail(found[section, "chi2"])
        assert found[section, "p_value"] == pytest.approx(want, rel=1e-9)
    t, df = found["selection", "welch_t"], found["selection", "df"]
    assert found["selection", "p_value"] == pytest.approx(tails.student_two_sided(t, df), rel=1e-9)
    shown = [v for (_, metric), v in found.items() if metric.endswith("p_value")]
    assert len(shown) == 6 and all(0 <= p <= 1 for p in shown)


def test_entry_runs(spark):
    bands = entry.entry(spark).collect()
    assert [r.basket_band for r in bands][:2] == ["1-3", "4-6"]


def test_fixture_regression_values(spark):
    """Counts recorded for the smallest folder when the mapping was defined."""
    if "sf0.001" not in FOLDER:
        pytest.skip("values are for the smallest folder")
    from orderlens.registry.queries import context

    c = context(spark, FOLDER)
    assert c.raw["raw_order_events"].count() == 1557
    assert c.stored["stg_orders"].count() == 1500
    assert c.stored["stg_orders"].filter("is_cancelled").count() == 37
    assert c.clean_orders.count() == 1438
    arms = c.arms.first()
    assert (arms.c_n_assigned, arms.t_n_assigned, arms.t_n_converted) <= (738, 735, 655)


def test_every_check_finds_something_on_broken_rows(spark):
    rows = callables()["quality_checks_broken"](spark, FOLDER).collect()
    assert len(rows) == 26 and not [r.check for r in rows if r.passed]


def test_changed_files_get_a_new_context(spark, tmp_path):
    from orderlens.registry.queries import context

    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    first = context(spark, str(tmp_path))
    assert context(spark, str(tmp_path)) is first
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "a.parquet"))
    assert context(spark, str(tmp_path)) is not first
