"""The four read-outs of the warehouse as one long metric table.

Each fact is scanned once, to a small table of sufficient statistics that is
kept; every read-out works on those rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators import effects as E
from orderlens.operators import experiment as X
from orderlens.operators import grain as G
from orderlens.operators.joins import drop_keys
from orderlens.operators.metrics import metric_rows, stack
from orderlens.operators.stats import spearman
from orderlens.params import BASKET_EDGES, BASKET_LABELS, Params
from orderlens.session import keep

Tables = Mapping[str, DataFrame]


def headline_orders(tables: Tables, exclude_flagged: bool = False) -> DataFrame:
    """Orders behind the headline.

    The published headline leaves out cancelled orders only; the written contract
    also leaves out flagged accounts. Both can be asked for.
    """
    orders = E.population(tables["fct_orders"], not_cancelled=True)
    if not exclude_flagged:
        return orders
    flagged = tables["dim_customer"].filter("is_test_account").select("customer_id")
    return drop_keys(orders, flagged, ["customer_id"])


def grain_report(tables: Tables) -> DataFrame:
    """Headline and bands from one scan: the bands and their total as grouping sets."""
    orders = headline_orders(tables)
    rates = keep(G.grain_with_total(orders, BASKET_EDGES, BASKET_LABELS))
    headline = rates.filter(F.col("ord").isNull())
    bands = rates.filter(F.col("ord").isNotNull())
    names = (
        "orders",
        "items",
        "item_fill_macro",
        "item_fill_micro",
        "item_miss_rate",
        "order_fill",
        "gap_pp",
        "mean_basket",
    )
    per_band = ("orders", "mean_basket", "item_fill_macro", "item_fill_micro", "order_fill")
    trend = [
        metric_rows(
            spearman(bands, "ord", rate),
            "grain",
            {f"{rate}_vs_basket_rho": "rho", f"{rate}_vs_basket_p": "p_value"},
        )
        for rate in ("item_fill_macro", "order_fill")
    ]
    band = F.col("basket_band")
    return stack(
        metric_rows(headline, "grain", {n: n for n in names}, n="orders"),
        metric_rows(bands, "grain_by_band", {n: n for n in per_band}, band, n="orders"),
        *trend,
    )


def stockout_report(cells: DataFrame) -> DataFrame:
    """Pooled, by tenure, basket-adjusted and by severity, from counted focal orders."""
    w = "weight"
    arm, sets = "had_stockout", [[], ["tenure"]]
    groups = E.effect(cells, "repeated", arm, ["tenure"], sets, w)
    strata = E.basket_strata(cells, weight=w)
    adjusted = E.stratified_effect(strata, "repeated", arm, "basket_q", weight=w)
    gradient = E.exposure_gradient(strata, "basket_q", "n_items", arm, "repeated", w)
    exposed = E.population(cells, exposed=True)
    severe = E.effect(exposed, "repeated", "had_high_intent_stockout", weight=w)
    shown = {
        "effect_pp": "effect_pp",
        "stockout_share": "treated_share",
        "stockout_repeat": "rate_treated",
        "clean_repeat": "rate_control",
        "population_at_risk": "n_treated",
    }
    tenure = F.coalesce("tenure", F.lit("all"))
    moved = {n: n for n in ("stratified_pp", "naive_pp", "shift_pp")}
    slope = {n: n for n in ("mean_size", "exposure_rate", "baseline_rate")}
    pp = {"effect_pp": "effect_pp", "n_high_intent": "n_treated", "n_other": "n_control"}
    return stack(
        metric_rows(groups, "stockout", shown, tenure, "ci_lo", "ci_hi", "n"),
        metric_rows(adjusted, "stockout_by_basket", moved),
        metric_rows(gradient, "exposure_gradient", slope, F.col("basket_q") + 1, n="n"),
        metric_rows(severe, "high_intent", pp, None, "ci_lo", "ci_hi", "n"),
    )


def substitution_report(cells: DataFrame, p: Params) -> DataFrame:
    """The three proxies, their spread and the stability of the swap ranking."""
    exposed = E.population(cells, exposed=True)
    proxies = E.proxy_estimates(exposed, p.min_cell, "weight")
    typed = E.substitution_contrasts(exposed, p.min_cell, "weight")
    ranked = E.ranking_stability(typed, "control", "substitution_type")
    stable = ranked.withColumn("s", F.col("is_stable").cast("int"))
    label = F.concat_ws(":", "proxy", "substitution_type")
    spread = {n: n for n in ("spread_pp", "best_pp", "worst_pp")}
    pp = {"effect_pp": "effect_pp", "n_control": "n_control", "repeat_rate": "rate_treated"}
    pair = F.concat_ws(":", "control", "substitution_type")
    return stack(
        metric_rows(proxies, "proxy", pp, label, "ci_lo", "ci_hi", "n_treated"),
        metric_rows(typed, "swap_contrast", pp, pair, "ci_lo", "ci_hi", "n_treated"),
        metric_rows(E.proxy_spread(proxies), "proxy_spread", spread),
        metric_rows(stable, "ranking", {"is_stable": "s"}, F.concat_ws("=", "control", "ranking")),
    )


def experiment_report(frame: DataFrame, p: Params) -> DataFrame:
    """Split, power, conversion, selection and both read-outs."""
    counted = X.arm_statistics(frame, "variant", "n_items")
    wide = keep(X.side_by_side(counted, "variant", "control", "treatment"))
    effect = {
        "effect_pp": "effect_pp",
        "control": "rate_control",
        "treatment": "rate_treated",
        "n_control": "n_control",
        "n_treatment": "n_treatment",
        "p_value": "p_value",
    }
    split = {
        "chi2": "chi2",
        "p_value": "p_value",
        "control_share": "observed_share",
        "expected_share": "expected_share",
        "n_control": "n_control",
        "n_treatment": "n_treatment",
        "detected": "d",
    }
    moved = {n: n for n in ("welch_t", "df", "p_value", "mean_control", "mean_treatment")}
    able = {n: n for n in ("mde_pp", "n_per_arm", "baseline_rate")}
    lost = {**effect, "relative_loss": "relative_loss"}
    parts = [
        metric_rows(X.power(wide), "power", able, n="n_per_arm"),
        metric_rows(X.conversion_effect(wide), "conversion", lost, None, "ci_lo", "ci_hi"),
        metric_rows(X.selection_evidence(wide), "selection", moved),
    ]
    for stage in ("assigned", "checkout"):
        checked = X.srm(wide, stage, 0.5, p.srm_threshold)
        checked = checked.withColumn("d", F.col("srm_detected").cast("int"))
        parts.append(metric_rows(checked, f"srm_{stage}", split))
    for who in X.POPULATIONS:
        shown = X.readout(wide, who)
        parts.append(metric_rows(shown, f"readout_{who}", effect, None, "ci_lo", "ci_hi"))
    return stack(*parts)


def analysis_report(tables: Tables, p: Params) -> DataFrame:
    """All four read-outs: section, metric, by, value, interval and n."""
    cells = keep(E.focal_cells(E.focal_orders(tables["fct_customer_orders"])))
    frame = X.experiment_frame(
        tables["fct_sessions"], tables["fct_orders"], tables["fct_customer_orders"]
    )
    return stack(
        grain_report(tables),
        stockout_report(cells),
        substitution_report(cells, p),
        experiment_report(frame, p),
    )
