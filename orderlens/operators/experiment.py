"""Experiment read-outs at assignment and at exposure, from one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import outcome_bool, safe_ratio
from orderlens.functions.tails import chi2_critical, chi2_p, student_p
from orderlens.operators.effects import rate_gap
from orderlens.operators.joins import left_join_known, left_join_sparse
from orderlens.operators.stats import mde, split_statistics, welch_columns, yates_chi2


def experiment_frame(
    sessions: DataFrame, orders: DataFrame, customer_orders: DataFrame, bucketed: bool = False
) -> DataFrame:
    """Assigned, unflagged sessions with basket size and repeat outcome.

    Every assigned session stays, converted or not. ``bucketed`` says that both facts lie
    in buckets by order: then only the converted sessions move.
    """
    assigned = sessions.filter(
        F.col("is_in_experiment") & ~F.coalesce("is_test_account", F.lit(False))
    )
    sizes = orders.select("order_id", "n_items")
    outcomes = customer_orders.select("order_id", "repeat_within_30d", "is_observable_30d")
    facts = sizes.join(outcomes, "order_id", "left")
    join = left_join_known if bucketed else left_join_sparse
    return join(assigned, facts, "order_id")


def arm_statistics(
    frame: DataFrame, arm: str, size: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """One row per arm with every sufficient statistic of the read-outs."""
    went = F.coalesce("converted", F.lit(False))
    measures = [
        F.count(F.lit(1)).alias("n_assigned"),
        F.count_if(went).alias("n_converted"),
    ]
    if "repeat_within_30d" in frame.columns:
        repeated = outcome_bool(F.col("repeat_within_30d"))
        seen = went & F.coalesce("is_observable_30d", F.lit(False))
        measures += [
            F.count_if(repeated).alias("k_assigned"),
            F.count_if(seen).alias("n_exposed"),
            F.count_if(seen & repeated).alias("k_exposed"),
        ]
    if size:
        basket = F.when(went, F.col(size))
        measures += [
            F.count(basket).alias("n_size"),
            F.avg(basket).alias("mean_size"),
            F.var_samp(basket).alias("var_size"),
        ]
    return frame.groupBy(*by, arm).agg(*measures)


def side_by_side(
    stats: DataFrame, arm: str, control: str, treatment: str, by: Sequence[str] = ()
) -> DataFrame:
    """The two arms' statistics on one row, as c_... and t_... columns."""
    names = [c for c in stats.columns if c not in {arm, *by}]
    picks = [
        F.max(F.when(F.col(arm) == value, F.col(c))).alias(f"{prefix}_{c}")
        for prefix, value in (("c", control), ("t", treatment))
        for c in names
    ]
    return stats.groupBy(*by).agg(*picks)


def _counts(n: str, k: str) -> tuple[Column, Column, Column, Column]:
    return F.col(f"t_{n}"), F.col(f"t_{k}"), F.col(f"c_{n}"), F.col(f"c_{k}")


POPULATIONS = {
    "assigned": ("n_assigned", "k_assigned"),
    "exposed": ("n_exposed", "k_exposed"),
}


def readout(wide: DataFrame, population: str, by: Sequence[str] = ()) -> DataFrame:
    """Repeat effect among everyone assigned, or among observable converters.

    "assigned" is the intention-to-treat estimate; "exposed" conditions on
    converting and is biased when the treatment moves conversion.
    """
    counts = _counts(*POPULATIONS[population])
    out = wide.select(
        *by,
        F.lit(population).alias("population"),
        counts[2].alias("n_control"),
        counts[0].alias("n_treatment"),
        *[v.alias(k) for k, v in rate_gap(*counts).items()],
        yates_chi2(*counts).alias("chi2"),
    )
    return out.withColumn("p_value", chi2_p(F.col("chi2")))


def conversion_effect(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Conversion difference, its test and the relative loss."""
    counts = _counts("n_assigned", "n_converted")
    gap = rate_gap(*counts)
    loss = safe_ratio(gap["rate_treated"] - gap["rate_control"], gap["rate_control"])
    out = wide.select(
        *by,
        counts[2].alias("n_control"),
        counts[0].alias("n_treatment"),
        *[v.alias(k) for k, v in gap.items()],
        loss.alias("relative_loss"),
        yates_chi2(*counts).alias("chi2"),
    )
    return out.withColumn("p_value", chi2_p(F.col("chi2")))


def srm(
    wide: DataFrame, stage: str, expected: float, threshold: float, by: Sequence[str] = ()
) -> DataFrame:
    """Split check of the assigned or the converted sessions."""
    column = {"assigned": "n_assigned", "checkout": "n_converted"}[stage]
    n_c, n_t = F.col(f"c_{column}"), F.col(f"t_{column}")
    parts = split_statistics(n_c, n_t, expected)
    out = wide.select(
        *by,
        F.lit(stage).alias("stage"),
        n_c.alias("n_control"),
        n_t.alias("n_treatment"),
        *[v.alias(k) for k, v in parts.items()],
    )
    tested = out.withColumn("p_value", chi2_p(F.col("chi2")))
    return tested.withColumn("srm_detected", F.col("chi2") > chi2_critical(threshold))


def selection_evidence(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Basket size of converters between arms: random loss cannot move it."""
    sides = [F.col(f"{s}_{c}") for s in "ct" for c in ("n_size", "mean_size", "var_size")]
    t, dof = welch_columns(*sides)
    out = wide.select(
        *by,
        F.col("c_mean_size").alias("mean_control"),
        F.col("t_mean_size").alias("mean_treatment"),
        t.alias("welch_t"),
        dof.alias("df"),
    )
    return out.withColumn("p_value", student_p(F.col("welch_t"), F.col("df")))


def power(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What the design could detect, from arm sizes and the control's base rate."""
    n = F.least("c_n_assigned", "t_n_assigned")
    base = safe_ratio(F.col("c_k_assigned"), F.col("c_n_assigned"))
    return wide.select(
        *by,
        n.alias("n_per_arm"),
        base.alias("baseline_rate"),
        mde(n, base).alias("mde_pp"),
    )
