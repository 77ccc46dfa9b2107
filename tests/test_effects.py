import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.operators import effects as E
from orderlens.operators import grain as G
from orderlens.operators.checks import check_fill_order
from orderlens.operators.quantiles import quantile_bucket, quantile_profile
from orderlens.operators.rollup import rollup_items


def frame(spark, n=400, seed=3):
    r = random.Random(seed)
    rows = [
        (r.choice(["new", "established"]), r.random() < 0.4, r.random() < 0.3, r.randrange(1, 9))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "tenure string, had boolean, rep boolean, size int")


def pandas_edges(values, n):
    return pd.qcut(values, n, labels=False, duplicates="drop")


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("buckets", [2, 4, 5])
def test_quantile_buckets_equal_the_reference_binning(spark, seed, buckets):
    r = random.Random(seed)
    values = [int(r.gammavariate(2, 3)) + 1 for _ in range(1001)]
    pdf = pd.DataFrame({"i": range(len(values)), "x": values})
    want = pandas_edges(pdf.x, buckets)
    got = quantile_bucket(spark.createDataFrame(pdf), "x", buckets, "b").toPandas()
    assert got.sort_values("i").b.tolist() == want.tolist()


def test_quantile_buckets_per_group_and_with_weights(spark):
    df = spark.createDataFrame(
        [("a", x) for x in (1, 2, 3, 4)] + [("b", x) for x in (10, 10, 10, 40)], "g string, x int")
    got = quantile_bucket(df, "x", 2, "b", ["g"]).collect()
    assert sorted((r.g, r.x, r.b) for r in got) == [
        ("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, 1),
        ("b", 10, 0), ("b", 10, 0), ("b", 10, 0), ("b", 40, 0)]
    weighted = spark.createDataFrame([(1, 3), (5, 3)], "x int, w long")
    got = quantile_bucket(weighted, "x", 2, "b", weight="w").collect()
    assert sorted((r.x, r.b) for r in got) == [(1, 0), (5, 1)]


def test_all_tied_values_make_one_bucket(spark):
    df = spark.createDataFrame([(7,)] * 9, "x int")
    assert {r.b for r in quantile_bucket(df, "x", 5, "b").collect()} == {0}


def test_profile_interpolates_even_counts(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 10)], "x int").withColumn("c", F.lit("k"))
    row = quantile_profile(df, "x", ["c"]).first()
    assert (row.lowest, row.median, row.highest, row.n) == (1.0, 2.5, 10.0, 4)
    rough = quantile_profile(df, "x", ["c"], exact=False).first()
    assert rough.median in (2.0, 3.0)


def test_grouping_sets_equal_separate_groupings(spark):
    df = frame(spark)
    sets = {r.tenure: r for r in E.effect(df, "rep", "had", ["tenure"], [[], ["tenure"]]).collect()}
    pooled = E.effect(df, "rep", "had").first()
    assert sets[None].effect_pp == pooled.effect_pp and sets[None].n == 400
    assert sum(sets[t].n for t in ("new", "established")) == 400
    for row in E.effect(df, "rep", "had", ["tenure"]).collect():
        assert sets[row.tenure].ci_lo == row.ci_lo


def test_weights_equal_repeated_rows(spark):
    df = frame(spark)
    cells = df.groupBy("tenure", "had", "rep", "size").agg(F.count(F.lit(1)).alias("w"))
    a, b = E.effect(df, "rep", "had").first(), E.effect(cells, "rep", "had", weight="w").first()
    assert a.asDict() == b.asDict()
    x = E.stratified_effect(df, "rep", "had", "size").first()
    y = E.stratified_effect(cells, "rep", "had", "size", weight="w").first()
    assert abs(x.stratified_pp - y.stratified_pp) < 1e-9
    g1 = {r.size: tuple(r) for r in E.exposure_gradient(df, "size", "size", "had", "rep").collect()}
    g2 = {r.size: tuple(r) for r in
          E.exposure_gradient(cells, "size", "size", "had", "rep", "w").collect()}
    assert g1 == g2


def test_one_stratum_changes_nothing(spark):
    df = frame(spark).withColumn("s", F.lit(1))
    row = E.stratified_effect(df, "rep", "had", "s").first()
    assert abs(row.stratified_pp - row.naive_pp) < 1e-9


def test_a_stratum_without_an_arm_leaves_no_adjusted_effect(spark):
    df = spark.createDataFrame(
        [(1, True, True), (1, False, False), (2, True, True)], "s int, had boolean, rep boolean")
    assert E.stratified_effect(df, "rep", "had", "s").first().stratified_pp is None


def test_unknown_outcome_is_negative_only_after_the_censoring_filter(spark):
    df = spark.createDataFrame(
        [(None, True, False), (None, False, False), (True, True, None)],
        "repeat_within_30d boolean, is_observable_30d boolean, is_test_account boolean")
    assert sorted(r.repeated for r in E.focal_orders(df).collect()) == [False, True]


SWAPS = "offer_arm string, substitution_type string, repeated boolean"


def swaps(spark):
    rows = []
    for kind, hits in (("near", 8), ("far", 5), ("odd", 2)):
        rows += [("accepted", kind, i < hits) for i in range(10)]
    rows += [("accepted", "rare", True)] * 2
    rows += [("declined", None, i < 4) for i in range(10)]
    rows += [("not_offered", None, i < 5) for i in range(10)]
    return spark.createDataFrame(rows, SWAPS)


def test_types_against_both_controls(spark):
    got = {(r.control, r.substitution_type): r for r in
           E.substitution_contrasts(swaps(spark), 10).collect()}
    assert len(got) == 6  # the rare type is below the cell size
    assert round(got["A_vs_declined", "near"].effect_pp, 6) == 40.0
    assert round(got["B_vs_not_offered", "odd"].effect_pp, 6) == -30.0
    stable = E.ranking_stability(
        E.substitution_contrasts(swaps(spark), 10), "control", "substitution_type").collect()
    assert {r.ranking for r in stable} == {"near > far > odd"}
    assert all(r.is_stable for r in stable)


def test_one_control_is_never_called_stable(spark):
    one = E.substitution_contrasts(swaps(spark), 10).filter("control = 'A_vs_declined'")
    assert not E.ranking_stability(one, "control", "substitution_type").first().is_stable


def test_proxies_and_their_spread(spark):
    est = E.proxy_estimates(swaps(spark), 10)
    got = {(r.proxy, r.substitution_type): r.effect_pp for r in est.collect()}
    accepted = 17 / 32 * 100
    assert abs(got["A", None] - (accepted - 40)) < 1e-9
    assert abs(got["B", None] - (accepted - 50)) < 1e-9
    spread = E.proxy_spread(est).first()
    assert abs(spread.spread_pp - (max(got.values()) - min(got.values()))) < 1e-12


def test_verdict_needs_zero_inside(spark):
    df = spark.createDataFrame([(-1.0, 1.0), (0.5, 2.0)], "ci_lo double, ci_hi double")
    assert [r.verdict for r in E.ci_verdict(df).collect()] == ["indistinguishable", "distinct"]


def test_break_even_from_the_published_effect(spark):
    df = spark.createDataFrame(
        [(0.34769509335391374, -8.097418783748456)], "treated_share double, effect_pp double")
    row = E.break_even(df).first()
    assert round(row.lost_per_month) == 141
    assert row.value_year_2sig == 680000.0


def test_order_fill_can_exceed_the_micro_item_fill_only(spark):
    """One clean single-item order and one lost 100-item order."""
    df = spark.createDataFrame(
        [(1, 0, 1.0, True), (100, 100, 0.0, False)],
        "n_items long, n_stocked_out long, item_fill_rate double, is_clean_order boolean")
    row = G.grain_summary(df).first()
    assert row.order_fill == 0.5 and row.item_fill_macro == 0.5
    assert abs(row.item_fill_micro - 1 / 101) < 1e-12


def test_rollup_takes_the_worst_swap_and_counts_everything(spark):
    df = spark.createDataFrame(
        [
            (1, 2, 4.0, True, True, "same_brand_diff_size", True),
            (1, 1, 3.0, True, True, "diff_product_same_cat", False),
            (1, 1, 1.0, False, False, None, None),
            (2, 5, 9.0, False, False, None, True),
            (3, 1, 1.0, True, False, None, None),
        ],
        "order_id int, quantity int, line_value_aed double, was_stocked_out boolean,"
        " was_substituted boolean, substitution_type string, is_high_intent_category boolean",
    )
    got = {r.order_id: r for r in rollup_items(df).collect()}
    assert (got[1].n_items, got[1].n_units, got[1].n_stocked_out, got[1].n_substituted) == (
        3, 4, 2, 2)
    assert got[1].worst_sub_rank == 1 and got[1].had_high_intent_stockout
    assert not got[2].had_any_stockout and got[2].worst_sub_rank is None
    assert got[3].had_any_stockout and not got[3].had_high_intent_stockout


def test_published_proxies_and_ranking(spark):
    """Published group sizes and repeat rates in, published estimates out."""
    accepted = {
        "same_brand_diff_size": (5538, 0.6973636691946551),
        "diff_brand_same_product": (4734, 0.671525137304605),
        "diff_product_same_cat": (1523, 0.6513460275771503),
    }
    groups = [("accepted", kind, n, round(n * rate)) for kind, (n, rate) in accepted.items()]
    pooled = sum(k for *_, k in groups) / 11795
    groups.append(("declined", None, 9079, round(9079 * (pooled - 0.034944893537537047))))
    groups.append(("not_offered", None, 12666, round(12666 * (pooled - 0.04067548366761054))))
    rows = [(arm, kind, hit, k if hit else n - k)
            for arm, kind, n, k in groups for hit in (True, False)]
    cells = spark.createDataFrame(rows, SWAPS + ", weight long")

    est = E.proxy_estimates(cells, 100, "weight")
    got = {(r.proxy, r.substitution_type): r for r in est.collect()}
    assert abs(got["A", None].effect_pp - 3.4944893537537047) < 1e-9
    assert abs(got["A", None].ci_lo - 2.2002788123862578) < 1e-9
    assert abs(got["B", None].ci_hi - 5.253282382715845) < 1e-9
    assert abs(got["C", "diff_product_same_cat"].ci_lo + 1.4380698807729115) < 1e-9
    assert abs(E.proxy_spread(est).first().spread_pp - 4.601764161750477) < 1e-9
    typed = E.substitution_contrasts(cells, 100, "weight")
    near = typed.filter("control = 'A_vs_declined' AND substitution_type LIKE 'same%'").first()
    assert abs(near.effect_pp - 5.125726981146306) < 1e-9
    ranked = E.ranking_stability(typed, "control", "substitution_type").collect()
    assert all(r.is_stable for r in ranked) and len(ranked) == 2
    assert ranked[0].ranking == " > ".join(accepted)
    weakest = E.ci_verdict(typed).filter("substitution_type = 'diff_product_same_cat'")
    assert {r.verdict for r in weakest.collect()} == {"indistinguishable"}


@pytest.mark.parametrize("seed", range(3))
def test_order_fill_never_exceeds_macro_item_fill(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(300):
        n = r.randrange(1, 20)
        out = sum(r.random() < 0.2 for _ in range(n))
        rows.append((i % 17, n, out, (n - out) / n, out == 0))
    df = spark.createDataFrame(
        rows, "g int, n_items int, n_stocked_out int, item_fill_rate double,"
        " is_clean_order boolean")
    assert check_fill_order(df, ["g"]).count() == 0
    banded = G.grain_by_band(df).collect()
    assert sum(b.orders for b in banded) == 300
    total = G.grain_with_total(df, (3, 6), ("s", "m", "l")).filter("ord IS NULL").first()
    assert total.asDict() | {"basket_band": 0, "ord": 0} == G.grain_summary(df).first().asDict() | {
        "basket_band": 0, "ord": 0}
