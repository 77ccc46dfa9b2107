"""From CSV files to a stored metric table, and what stops a run."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from orderlens.plans.run import CheckFailed, drift, run_all, score_accounts, sweep_accounts
from orderlens.plans.warehouse import MARTS
from orderlens.sources import raw
from orderlens.sources.tables import read_metrics
from orderlens.sources.tpch import TPCH_PARAMS, TpchSources

KEYS = ("order_id", "customer_id", "darkstore_id", "product_id", "session_id",
        "home_darkstore_id")


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The small tables as CSV with text keys, like an export would have them."""
    folder = str(tmp_path_factory.mktemp("export"))
    for name, df in TpchSources(spark, "/root/testdata/sf0.001").all().items():
        for key in set(KEYS) & set(df.columns):
            df = df.withColumn(key, F.concat(F.lit("K"), F.col(key)))
        names = [f.split()[0] for f in raw.SCHEMAS[name].split(", ")]
        raw.write_csv(df.select(*names), folder, name)
    return folder


def test_run_from_files_and_compare_two_runs(spark, source, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    warehouse = run_all(spark, source, first, TPCH_PARAMS)
    for name in MARTS:
        assert spark.read.parquet(f"{first}/marts/{name}").count() > 0
    assert spark.read.parquet(f"{first}/checks").filter("NOT passed").count() == 0
    found = {(r.section, r.metric, r.by): r for r in
             read_metrics(spark, f"{first}/metrics").collect()}
    assert found["grain", "orders", "all"].value == 1438
    assert round(found["grain", "item_fill_macro", "all"].value, 6) == 0.937497
    assert round(found["grain", "order_fill", "all"].value, 6) == 0.764951
    assert found["readout_assigned", "effect_pp", "all"].ci_lo is not None

    truth = warehouse["dim_customer"].select(
        "customer_id", F.col("is_test_account").alias("truth"))
    assert score_accounts(warehouse, truth, "truth").first().precision == 1.0
    swept = sweep_accounts(warehouse, truth, "truth", (1.0, 2.0)).collect()
    assert {r.recall for r in swept} == {1.0}

    run_all(spark, source, second, replace(TPCH_PARAMS, hot_rows=3, cell_rows=2))
    assert drift(spark, first, second, 1e-9).count() == 0


def test_a_failed_check_stops_the_analysis(spark, source, tmp_path):
    target = tmp_path / "bad"
    with pytest.raises(CheckFailed, match="any_flagged"):
        run_all(spark, source, str(target), replace(TPCH_PARAMS, mad_k=1000.0))
    assert (target / "checks").exists() and not (target / "metrics").exists()
