"""Differences of rates between groups, from one pass of sufficient statistics.

Each operator aggregates rows to counts by group, then works on those few rows.
The results are associations with their sample sizes, not causal claims.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.columns import (
    outcome_bool,
    round_significant,
    safe_ratio,
    split_offer,
)
from orderlens.operators.joins import with_scalars, with_totals
from orderlens.operators.quantiles import quantile_bucket
from orderlens.operators.ranks import before

# Fixed value: the normal quantile used for every 95% interval.
Z95 = 1.96

COUNTS = ("n_treated", "k_treated", "n_control", "k_control")


def population(
    df: DataFrame,
    *,
    not_cancelled: bool = False,
    observable: bool = False,
    not_flagged: bool = False,
    exposed: bool = False,
) -> DataFrame:
    """The analysis populations; a missing flag counts as not flagged."""
    if not_cancelled:
        df = df.filter(~F.col("is_cancelled"))
    if observable:
        df = df.filter(F.col("is_observable_30d"))
    if not_flagged:
        df = df.filter(~F.coalesce("is_test_account", F.lit(False)))
    if exposed:
        df = df.filter(F.col("had_stockout"))
    return df


def focal_orders(customer_orders: DataFrame) -> DataFrame:
    """Observable, unflagged orders with the repeat outcome as a plain boolean."""
    kept = population(customer_orders, observable=True, not_flagged=True)
    return kept.withColumn("repeated", outcome_bool(F.col("repeat_within_30d")))


# The attributes of a focal order that any read-out of the reports asks for.
CELL = (
    "segment",
    "tenure",
    "n_items",
    "had_stockout",
    "had_high_intent_stockout",
    "offer_arm",
    "substitution_type",
    "repeated",
)


def focal_cells(focal: DataFrame) -> DataFrame:
    """Focal orders counted per attribute combination, in the column ``weight``.

    One scan of the orders serves every read-out that accepts a weight.
    """
    return split_offer(focal).groupBy(*CELL).agg(F.count(F.lit(1)).alias("weight"))


def count_where(condition: Column, weight: str | None) -> Column:
    """Aggregate: number of rows, or sum of their weights, where a condition holds."""
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def arm_counts(
    df: DataFrame, outcome: str, treated: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """by..., size and successes of the treated and the control arm."""
    arm, hit = F.col(treated), F.col(outcome)
    return df.groupBy(*by).agg(
        count_where(arm, weight).alias("n_treated"),
        count_where(arm & hit, weight).alias("k_treated"),
        count_where(~arm, weight).alias("n_control"),
        count_where(~arm & hit, weight).alias("k_control"),
    )


def rate_gap(n1: Column, k1: Column, n0: Column, k0: Column) -> dict[str, Column]:
    """Rates, their difference in pp and its Wald interval; NULL for an empty arm."""
    p1, p0 = safe_ratio(k1, n1), safe_ratio(k0, n0)
    gap = (p1 - p0) * 100
    spread = safe_ratio(p1 * (1 - p1), n1) + safe_ratio(p0 * (1 - p0), n0)
    half = Z95 * F.sqrt(spread) * 100
    return {
        "rate_treated": p1,
        "rate_control": p0,
        "effect_pp": gap,
        "ci_lo": gap - half,
        "ci_hi": gap + half,
    }


def with_gap(counts: DataFrame) -> DataFrame:
    return counts.withColumns(rate_gap(*[F.col(c) for c in COUNTS]))


def diff_in_proportions(
    df: DataFrame, outcome: str, treated: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Effect of a boolean arm on a boolean outcome, per ``by`` group."""
    return with_gap(arm_counts(df, outcome, treated, by, weight))


def effect(
    df: DataFrame,
    outcome: str,
    treated: str,
    by: Sequence[str] = (),
    grouping_sets: Sequence[Sequence[str]] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Effects with group size and treated share.

    ``grouping_sets`` gives several groupings from one scan: rows are counted
    once at the finest grain and the sets are formed over those counts. A column
    outside a row's set is NULL.
    """
    counts = arm_counts(df, outcome, treated, by, weight)
    if grouping_sets is not None:
        sets = [[F.col(c) for c in s] for s in grouping_sets]
        sums = [F.sum(c).alias(c) for c in COUNTS]
        counts = counts.groupingSets(sets, *[F.col(c) for c in by]).agg(*sums)
    n = F.col("n_treated") + F.col("n_control")
    shares = {"n": n, "treated_share": safe_ratio(F.col("n_treated"), n)}
    return with_gap(counts.withColumns(shares))


def rate_table(df: DataFrame, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and outcome rate per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        safe_ratio(F.count_if(outcome), F.count(outcome)).alias("rate"),
    )


def stratified_effect(
    df: DataFrame,
    outcome: str,
    treated: str,
    stratum: str,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Effect reweighted to the population's strata, next to the plain one.

    A stratum without one of the arms has no effect, and then neither has the sum.
    """
    known = df.filter(F.col(stratum).isNotNull())
    strata = effect(known, outcome, treated, [*by, stratum], weight=weight)
    weighted = F.sum(F.col("effect_pp") * F.col("n")) / F.sum("n")
    complete = F.count("effect_pp") == F.count(F.lit(1))
    pooled = strata.groupBy(*by).agg(
        F.when(complete, weighted).alias("stratified_pp"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.count(F.lit(1)).alias("n_strata"),
    )
    plain = rate_gap(*[F.col(c) for c in COUNTS])["effect_pp"]
    return pooled.select(
        *by,
        "n_strata",
        plain.alias("naive_pp"),
        "stratified_pp",
        (F.col("stratified_pp") - plain).alias("shift_pp"),
    )


def exposure_gradient(
    df: DataFrame,
    stratum: str,
    size: str,
    treated: str,
    outcome: str,
    weight: str | None = None,
) -> DataFrame:
    """Per stratum: mean size, exposure rate and outcome rate of the unexposed."""
    arm, hit = F.col(treated), F.col(outcome)
    times = F.lit(1) if weight is None else F.col(weight)

    def n(condition: Column) -> Column:
        return count_where(condition, weight)

    return df.groupBy(stratum).agg(
        n(F.lit(True)).alias("n"),
        safe_ratio(F.sum(F.col(size) * times), n(F.col(size).isNotNull())).alias("mean_size"),
        safe_ratio(n(arm), n(arm.isNotNull())).alias("exposure_rate"),
        safe_ratio(n(~arm & hit), n(~arm)).alias("baseline_rate"),
    )


def basket_strata(focal: DataFrame, buckets: int = 5, weight: str | None = None) -> DataFrame:
    return quantile_bucket(focal, "n_items", buckets, "basket_q", weight=weight)


def contrast(
    df: DataFrame, arm: str, treated: str, control: str, outcome: str, by: Sequence[str] = ()
) -> DataFrame:
    """Effect between two named arms; rows of other arms are left out."""
    two = df.filter(F.col(arm).isin(treated, control))
    flagged = two.withColumn("_treated", F.col(arm) == treated)
    return diff_in_proportions(flagged, outcome, "_treated", by)


def contrast_by_type(
    df: DataFrame,
    kind: str,
    arm: str,
    treated: str,
    controls: Mapping[str, str],
    outcome: str,
    min_n: int = 100,
    weight: str | None = None,
) -> DataFrame:
    """Each type of the treated arm against every shared control arm.

    ``controls`` maps a label to an arm. Groups below ``min_n`` are left out. One
    scan counts (arm, type); the rest happens on those few rows.
    """
    cells = df.groupBy(F.col(arm).alias("arm"), F.col(kind).alias("kind")).agg(
        count_where(F.lit(True), weight).alias("n"),
        count_where(F.col(outcome), weight).alias("k"),
    )

    def total(of: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("arm") == name, F.col(of))), F.lit(0))

    against = F.array(
        *[
            F.struct(
                F.lit(label).alias("control"),
                total("n", name).alias("n_control"),
                total("k", name).alias("k_control"),
            )
            for label, name in controls.items()
        ]
    )
    return with_gap(
        with_scalars(cells, cells.agg(against.alias("against")))
        .filter((F.col("arm") == treated) & (F.col("n") >= min_n) & F.col("kind").isNotNull())
        .select(
            F.col("kind").alias(kind),
            F.inline("against"),
            F.col("n").alias("n_treated"),
            F.col("k").alias("k_treated"),
        )
    )


# The two control arms whose selection problems are opposite.
CONTROLS = {"A_vs_declined": "declined", "B_vs_not_offered": "not_offered"}


def substitution_contrasts(
    exposed: DataFrame, min_n: int, weight: str | None = None
) -> DataFrame:
    """Per swap type and control arm; ``exposed`` carries offer_arm and repeated."""
    return contrast_by_type(
        exposed, "substitution_type", "offer_arm", "accepted", CONTROLS, "repeated", min_n, weight
    )


def proxy_estimates(exposed: DataFrame, min_n: int, weight: str | None = None) -> DataFrame:
    """The three readings of a good substitution: consent, forgiveness, distance."""
    pooled_arms = (("A", "declined"), ("B", "not_offered"))
    cells = exposed.groupBy("offer_arm").agg(
        count_where(F.lit(True), weight).alias("n"),
        count_where(F.col("repeated"), weight).alias("k"),
    )

    def of(col: str, arm: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("offer_arm") == arm, F.col(col))), F.lit(0))

    pairs = F.array(
        *[
            F.struct(
                F.lit(label).alias("proxy"),
                F.lit(None).cast("string").alias("substitution_type"),
                of("n", "accepted").alias("n_treated"),
                of("k", "accepted").alias("k_treated"),
                of("n", arm).alias("n_control"),
                of("k", arm).alias("k_control"),
            )
            for label, arm in pooled_arms
        ]
    )
    pooled = with_gap(cells.agg(pairs.alias("p")).select(F.inline("p")))
    typed = substitution_contrasts(exposed, min_n, weight).filter(
        F.col("control") == "B_vs_not_offered"
    )
    return pooled.unionByName(typed.withColumn("proxy", F.lit("C")).select(*pooled.columns))


def proxy_spread(estimates: DataFrame, value: str = "effect_pp") -> DataFrame:
    """Largest, smallest and spread of the estimates."""
    return estimates.agg(
        F.max(value).alias("best_pp"),
        F.min(value).alias("worst_pp"),
        (F.max(value) - F.min(value)).alias("spread_pp"),
    )


def rank_effects(
    effects: DataFrame, within: str, name: str, value: str = "effect_pp", cell_rows: int | None = None
) -> DataFrame:
    """Rank groups by effect, largest first, inside each control.

    With ``cell_rows`` a control may have any number of groups; no task holds one whole.
    """
    order = [F.col(value).desc(), F.col(name).asc()]
    if cell_rows is None:
        place = F.row_number().over(Window.partitionBy(within).orderBy(*order))
        return effects.withColumn("rank", place)
    placed = before(effects, order, "rank", by=[within], cell_rows=cell_rows)
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int"))


def ranking_stability(
    effects: DataFrame, within: str, name: str, value: str = "effect_pp"
) -> DataFrame:
    """Ranking per control, and whether more than one control gives the same one."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", name)))
    ranked = rank_effects(effects, within, name, value)
    orders = ranked.groupBy(within).agg(
        F.array_join(F.transform(pairs, lambda s: s[name]), " > ").alias("ranking")
    )
    same = F.min("ranking") == F.max("ranking")
    return with_totals(orders, is_stable=same & (F.count(F.lit(1)) > 1))


def ci_verdict(df: DataFrame, lo: str = "ci_lo", hi: str = "ci_hi") -> DataFrame:
    """Whether an interval spans zero."""
    spans = (F.col(lo) < 0) & (F.col(hi) > 0)
    return df.withColumn("verdict", F.when(spans, "indistinguishable").otherwise("distinct"))


def break_even(
    effects: DataFrame,
    customers_per_month: float = 5000,
    value_per_customer: float = 400,
    effectiveness: float = 0.5,
) -> DataFrame:
    """Customers lost per month and their yearly value, under stated assumptions."""
    lost = customers_per_month * F.col("treated_share") * F.abs("effect_pp") / 100
    month, year = lost * value_per_customer, lost * value_per_customer * 12
    return effects.withColumns(
        {
            "lost_per_month": lost,
            "value_month": month,
            "value_year": year,
            "value_year_realistic": year * effectiveness,
            "value_month_2sig": round_significant(month),
            "value_year_2sig": round_significant(year),
            "value_year_realistic_2sig": round_significant(year * effectiveness),
        }
    )


def effect_ratio(effects: DataFrame, group: str, num: str, den: str) -> DataFrame:
    """How many times larger one group's effect is, and its share of the rows."""

    def of(col: str, name: str) -> Column:
        return F.max(F.when(F.col(group) == name, F.col(col)))

    one = effects.agg(
        of("effect_pp", num).alias("a"), of("effect_pp", den).alias("b"),
        of("n", num).alias("na"), of("n", den).alias("nb"),
    )
    return one.select(
        F.abs(safe_ratio(F.col("a"), F.col("b"))).alias("effect_ratio"),
        safe_ratio(F.col("na"), F.col("na") + F.col("nb")).alias("focal_share"),
    )


def orders_lost(effects: DataFrame, order_fill: str, per: int = 1000) -> DataFrame:
    """Broken orders and repeat orders lost among ``per`` orders."""
    broken = (1 - F.col(order_fill)) * per
    return effects.withColumns(
        {"broken_orders": broken, "orders_lost": broken * F.abs("effect_pp") / 100}
    )
