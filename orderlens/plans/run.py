"""The whole run: land, build, check, analyse, compare with the last output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.functions.columns import split_offer
from orderlens.operators import effects as E
from orderlens.operators import experiment as X
from orderlens.operators import scoring
from orderlens.operators.checks import run_checks
from orderlens.operators.metrics import metrics_drift
from orderlens.operators.outliers import sweep_threshold
from orderlens.params import Params
from orderlens.plans.reports import analysis_report
from orderlens.plans.warehouse import Warehouse
from orderlens.session import configure, keep
from orderlens.sources.raw import land_raw
from orderlens.sources.tables import read_metrics, write_metrics, write_table


class CheckFailed(RuntimeError):
    """A data-quality check found violations; the message names them."""


def run_all(
    spark: SparkSession,
    source: str,
    target: str,
    params: Params | None = None,
    partitioned: bool = False,
    buckets: int | None = None,
) -> Warehouse:
    """CSV folder -> stored raw tables, marts, check results and metric table.

    Raises after storing the check results when any check fails, before the
    analysis: numbers from a broken build are never published.
    """
    p = params or Params()
    root = target.rstrip("/")
    landed = land_raw(configure(spark), source, f"{root}/raw")
    warehouse = Warehouse(spark, landed, p, f"{root}/marts", partitioned, buckets)
    results = write_table(
        run_checks(warehouse.build(), p.retention_window_days), f"{root}/checks"
    )
    # One row per declared check, so the failed ones fit a message.
    failed = [f"{r.check} {r.table_name}.{r.column_name}: {r.n_violations}"
              for r in results.filter("NOT passed").collect()]
    if failed:
        raise CheckFailed("; ".join(sorted(failed)))
    write_metrics(analysis_report(warehouse, p), f"{root}/metrics")
    return warehouse


def score_accounts(warehouse: Warehouse, truth: DataFrame, label: str) -> DataFrame:
    """Precision and recall of the account flag against a truth kept elsewhere."""
    return scoring.score_flag(
        warehouse["dim_customer"], truth, "customer_id", "is_test_account", label
    )


def sweep_accounts(
    warehouse: Warehouse, truth: DataFrame, label: str, ks: tuple[float, ...] = (8, 20, 40, 60, 100)
) -> DataFrame:
    """The same for other thresholds."""
    activity = warehouse["int_customer_activity"]
    return sweep_threshold(activity, ks, truth, "customer_id", "order_count", label)


def score_run(
    warehouse: Warehouse, tenure_truth: DataFrame, swap_truth: DataFrame, path: str
) -> DataFrame:
    """Score the stored build against true effects kept elsewhere; stored, one row per check.

    ``tenure_truth`` has tenure and true_pp, ``swap_truth`` substitution_type and repair.
    The verdict needs all six: effects near the truth and in its order by tenure, swaps in
    the order of their true repair, a ranking that both controls agree on, no retention
    effect among converters, and a split that breaks only after assignment.
    """
    p = warehouse.params
    focal = E.focal_orders(warehouse["fct_customer_orders"])
    tenure = keep(E.effect(focal, "repeated", "had_stockout", ["tenure"]))
    exposed = split_offer(E.population(focal, exposed=True))
    typed = keep(E.substitution_contrasts(exposed, p.min_cell))
    frame = X.experiment_frame(
        warehouse["fct_sessions"], warehouse["fct_orders"], warehouse["fct_customer_orders"]
    )
    counted = X.arm_statistics(frame, "variant", "n_items")
    wide = keep(X.side_by_side(counted, "variant", "control", "treatment"))
    splits = [X.srm(wide, s, 0.5, p.srm_threshold) for s in ("assigned", "checkout")]
    swaps = typed.filter("control = 'B_vs_not_offered'")
    scored = scoring.scorecard(
        (
            "effects_near_truth",
            scoring.within_tolerance(tenure, tenure_truth, "tenure", "true_pp"),
            "within_tolerance",
        ),
        (
            "tenure_order",
            scoring.rank_matches(tenure, tenure_truth, "tenure", "effect_pp", "true_pp"),
            "order_recovered",
        ),
        (
            "swap_order",
            scoring.rank_matches(swaps, swap_truth, "substitution_type", "effect_pp", "repair"),
            "order_recovered",
        ),
        (
            "ranking_stable",
            E.ranking_stability(typed, "control", "substitution_type"),
            "is_stable",
        ),
        ("zero_covered", scoring.covers(X.readout(wide, "exposed"), 0.0), "covers"),
        ("srm_behaved", scoring.srm_consistency(*splits), "srm_consistent"),
    )
    return write_table(scored, path)


def drift(spark: SparkSession, old: str, new: str, tol: float = 0.0) -> DataFrame:
    """Metric rows that differ between two stored runs."""
    return metrics_drift(
        read_metrics(spark, f"{old}/metrics"), read_metrics(spark, f"{new}/metrics"), tol
    )
