"""Tests on aggregated counts: split, independence, means, ranks, power."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import safe_ratio
from orderlens.functions.tails import chi2_critical, chi2_p, student_p
from orderlens.operators.ranks import with_rank


def split_statistics(n_a: Column, n_b: Column, expected: float) -> dict[str, Column]:
    """Goodness of fit of an observed two-way split; no p-value."""
    total = n_a + n_b
    want_a, want_b = total * expected, total * (1 - expected)
    chi2 = safe_ratio(F.pow(n_a - want_a, 2), want_a) + safe_ratio(F.pow(n_b - want_b, 2), want_b)
    return {
        "observed_share": safe_ratio(n_a, total),
        "expected_share": F.lit(expected),
        "chi2": chi2,
    }


def srm_check(
    df: DataFrame,
    arm: str,
    control: str = "control",
    treatment: str = "treatment",
    expected: float = 0.5,
    threshold: float = 0.001,
    by: Sequence[str] = (),
) -> DataFrame:
    """Sample-ratio mismatch: does the control share match the intended one?"""
    counts = df.groupBy(*by).agg(
        F.count_if(F.col(arm) == control).alias("n_control"),
        F.count_if(F.col(arm) == treatment).alias("n_treatment"),
    )
    return srm_from_counts(counts, expected, threshold)


def srm_from_counts(
    counts: DataFrame, expected: float = 0.5, threshold: float = 0.001
) -> DataFrame:
    """The same test on rows that already hold n_control and n_treatment."""
    parts = split_statistics(F.col("n_control"), F.col("n_treatment"), expected)
    tested = counts.withColumns(parts).withColumn("p_value", chi2_p(F.col("chi2")))
    return tested.withColumn("srm_detected", F.col("chi2") > chi2_critical(threshold))


def crosstab2(df: DataFrame, arm: str, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., arm, rows without and with the outcome."""
    known = df.filter(F.col(arm).isNotNull() & F.col(outcome).isNotNull())
    return known.groupBy(*by, arm).agg(
        F.count_if(~F.col(outcome)).alias("n_without"), F.count_if(outcome).alias("n_with")
    )


def yates_chi2(n1: Column, k1: Column, n0: Column, k0: Column) -> Column:
    """Continuity-corrected chi-square of a 2x2 table; NULL for an empty margin.

    All four cells miss their expectation by the same amount, so it is computed
    once and cut by one half, never below zero.
    """
    total, hits = (n1 + n0).cast("double"), (k1 + k0).cast("double")
    off = F.abs(k1 - safe_ratio(n1 * hits, total))
    cut = F.greatest(off - 0.5, F.lit(0.0))
    weight = F.lit(0.0)
    for n in (n1, n0):
        for margin in (hits, total - hits):
            weight = weight + safe_ratio(total, n * margin)
    return F.pow(cut, 2) * weight


def chi2_2x2(df: DataFrame, arm: str, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """Independence of a two-valued arm and a boolean outcome."""
    cells = crosstab2(df, arm, outcome, by)
    n = F.col("n_with") + F.col("n_without")
    side = F.struct(F.col(arm), n.alias("n"), F.col("n_with").alias("k"))
    sides = cells.groupBy(*by).agg(
        F.min(side).alias("a"), F.max(side).alias("b"), F.count(F.lit(1)).alias("arms")
    )
    chi2 = yates_chi2(F.col("b.n"), F.col("b.k"), F.col("a.n"), F.col("a.k"))
    out = sides.select(*by, F.when(F.col("arms") == 2, chi2).alias("chi2"), F.lit(1).alias("df"))
    return out.withColumn("p_value", chi2_p(F.col("chi2")))


def mean_statistics(df: DataFrame, value: str, arm: str, by: Sequence[str] = ()) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, arm)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean"),
            F.var_samp(value).alias("variance"),
        )
    )


def welch_columns(n1: Column, m1: Column, v1: Column, n0: Column, m0: Column, v0: Column):
    """Welch t (first minus second) and its degrees of freedom."""
    a, b = safe_ratio(v1, n1), safe_ratio(v0, n0)
    t = safe_ratio(m1 - m0, F.sqrt(a + b))
    df = safe_ratio(
        F.pow(a + b, 2), safe_ratio(F.pow(a, 2), n1 - 1) + safe_ratio(F.pow(b, 2), n0 - 1)
    )
    return t, df


def welch_t(
    df: DataFrame,
    value: str,
    arm: str,
    first: str = "control",
    second: str = "treatment",
    by: Sequence[str] = (),
) -> DataFrame:
    """Unequal-variance t test of a metric between two arms."""
    stats = mean_statistics(df, value, arm, by)

    def of(col: str, name: str) -> Column:
        return F.max(F.when(F.col(arm) == name, F.col(col)))

    wide = stats.groupBy(*by).agg(
        *[
            of(col, name).alias(f"{col}_{side}")
            for side, name in (("first", first), ("second", second))
            for col in ("n", "mean", "variance")
        ]
    )
    t, dof = welch_columns(
        *[F.col(f"{c}_first") for c in ("n", "mean", "variance")],
        *[F.col(f"{c}_second") for c in ("n", "mean", "variance")],
    )
    out = wide.select(*by, "mean_first", "mean_second", t.alias("welch_t"), dof.alias("df"))
    return out.withColumn("p_value", student_p(F.col("welch_t"), F.col("df")))


def spearman(
    groups: DataFrame, x: str, y: str, by: Sequence[str] = (), cell_rows: int | None = None
) -> DataFrame:
    """Rank correlation over a table of ordered groups, ties at their mean rank.

    The input is usually one row per group (a band, a quintile), few by meaning: its ranks
    come from the arrays of both columns. With ``cell_rows`` it may have any number of rows,
    ranked over cells of a range partition.
    """
    known = groups.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if cell_rows is None:
        lists = known.groupBy(*by).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("_g"))

        def mid_ranks(part: str) -> Column:
            every = F.col("_g")[part]
            lower = F.transform(every, lambda v: F.size(F.filter(every, lambda o: o < v)))
            ties = F.transform(every, lambda v: F.size(F.filter(every, lambda o: o == v)))
            return F.zip_with(lower, ties, lambda low, n: low + (n + 1) / 2)

        both = F.arrays_zip(mid_ranks("x").alias("_rx"), mid_ranks("y").alias("_ry"))
        ranked = lists.select(*by, F.inline(both).alias("_rx", "_ry"))
    else:
        ranked = with_rank(known, x, "_rx", by=by, mid=True, cell_rows=cell_rows)
        ranked = with_rank(ranked, y, "_ry", by=by, mid=True, cell_rows=cell_rows)
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.corr("_rx", "_ry").alias("rho")
    )
    rho = F.col("rho")
    gap = 1 - rho * rho
    certain = F.abs(gap) < 1e-12
    t = F.when(certain, F.lit(float("inf"))).otherwise(
        rho * F.sqrt(safe_ratio(F.col("n_groups") - 2, gap))
    )
    return out.withColumn("p_value", student_p(t, F.col("n_groups") - 2))


def mde(n: Column, baseline: Column, alpha: float = 0.05, power: float = 0.80) -> Column:
    """Minimum detectable effect in pp for two arms of n rows each."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return z * F.sqrt(safe_ratio(2 * baseline * (1 - baseline), n)) * 100
