"""Published counts and rates in, published statistics out."""

import math

import pytest
from pyspark.sql import functions as F

from orderlens.functions import tails
from orderlens.operators import effects as E
from orderlens.operators import experiment as X
from orderlens.operators import stats as S


def close(a, b, rel=1e-9):
    return math.isclose(a, b, rel_tol=rel, abs_tol=1e-300)


def counted(spark, n1, k1, n0, k0):
    df = spark.createDataFrame([(n1, k1, n0, k0)], ",".join(f"{c} bigint" for c in E.COUNTS))
    return E.with_gap(df).first()


def test_split_mismatch_at_assignment_and_checkout(spark):
    df = spark.createDataFrame(
        [("a", 78560, 78443), ("c", 34589, 27993)],
        "s string, n_control bigint, n_treatment bigint",
    )
    got = {r.s: r for r in S.srm_from_counts(df).collect()}
    assert close(got["a"].chi2, 0.08718941676273702) and close(got["a"].p_value, 0.7677811079047923)
    assert not got["a"].srm_detected
    assert close(got["c"].chi2, 695.203349205842)
    assert close(got["c"].p_value, 3.301965129576621e-153, 1e-9)
    assert got["c"].srm_detected


def test_split_just_around_the_threshold(spark):
    # chi-square of 10.8276 is the 0.001 point.
    df = spark.createDataFrame([(10165, 9835), (10166, 9834)], "n_control int, n_treatment int")
    got = [(r.p_value, r.srm_detected) for r in S.srm_from_counts(df).collect()]
    assert all(flag == (p < 0.001) for p, flag in got)


@pytest.mark.parametrize(
    "n1, r1, n0, r0, effect, lo, hi, p",
    [
        (78443, 0.35685784582435653, 78560, 0.4402876782077393, -8.342983238338276,
         -8.825585925769023, -7.860380550907528, 9.275870977980964e-250),
        (27366, 0.7047796535847402, 33775, 0.708660251665433, -0.3880598080692854,
         -1.1139452261622025, 0.33782561002363165, 0.29866452774715063),
        (78443, 0.24587279935749526, 78560, 0.30467158859470467, -5.879878923720941,
         -6.320786178741194, -5.438971668700688, 7.066606552812373e-150),
    ],
)
def test_experiment_effects(spark, n1, r1, n0, r0, effect, lo, hi, p):
    k1, k0 = round(n1 * r1), round(n0 * r0)
    got = counted(spark, n1, k1, n0, k0)
    assert close(got.effect_pp, effect) and close(got.ci_lo, lo) and close(got.ci_hi, hi)
    args = [F.lit(v) for v in (n1, k1, n0, k0)]
    chi2 = spark.range(1).select(S.yates_chi2(*args).alias("x")).first().x
    assert close(tails.chi2_tail(chi2), p, 1e-8)


@pytest.mark.parametrize(
    "n, share, clean, hit, effect, lo, hi",
    [
        (67378, 0.34769509335391374, 0.6761848422106437, 0.5952106543731591,
         -8.097418783748456, -8.863234315247228, -7.331603252249684),
        (32271, 0.31337733568838894, 0.8266540301471252, 0.7975872639177296,
         -2.9066766229395635, -3.834956553763005, -1.9783966921161222),
    ],
)
def test_tenure_effects(spark, n, share, clean, hit, effect, lo, hi):
    n1 = round(n * share)
    n0 = n - n1
    got = counted(spark, n1, round(n1 * hit), n0, round(n0 * clean))
    assert close(got.effect_pp, effect) and close(got.ci_lo, lo) and close(got.ci_hi, hi)


def test_minimum_detectable_effect(spark):
    mde = S.mde(F.lit(78443), F.lit(0.30467158859470467))
    assert close(spark.range(1).select(mde.alias("x")).first().x, 0.6511075089911007)


def test_rank_correlation_of_the_published_bands(spark):
    item = [0.9378041362530409, 0.9373616935456203, 0.9406163786892839, 0.947000451022536,
            0.9509029189835716]
    order = [0.8584805993084902, 0.7327408149214496, 0.6275157538239459, 0.5269214301006209,
             0.4356151268549545]
    df = spark.createDataFrame(list(zip(range(1, 6), item, order)), "o int, i double, c double")
    up = S.spearman(df, "o", "i").first()
    assert close(up.rho, 0.9) and close(up.p_value, 0.03738607346849874, 1e-7)
    down = S.spearman(df, "o", "c").first()
    assert close(down.rho, -1.0) and down.p_value < 1e-20


def test_rank_correlation_gives_ties_their_mean_rank(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 5.0), (4, 1.0)], "x int, y double")
    # ranks of y: 2.5, 2.5, 4, 1
    rho = S.spearman(df, "x", "y").first().rho
    x, y = [1, 2, 3, 4], [2.5, 2.5, 4, 1]
    mx, my = 2.5, 2.5
    want = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(
        sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    assert close(rho, want)


def test_student_tail_against_known_points():
    assert close(tails.student_two_sided(2.228138852, 10), 0.05, 1e-8)
    assert close(tails.student_two_sided(1.0, 1), 0.5)
    assert tails.student_two_sided(0.0, 7) == 1.0
    assert tails.student_two_sided(math.inf, 3) == 0.0
    # The published t; its degrees of freedom are known only roughly.
    assert 2.99e-68 < tails.student_two_sided(17.479410115120462, 61750) < 3.02e-68


def test_normal_tail():
    assert close(tails.normal_two_sided(1.959963984540054), 0.05, 1e-12)


def test_welch_matches_its_definition(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 8.0, 5.0]
    df = spark.createDataFrame([("control", x) for x in a] + [("treatment", x) for x in b]
                               + [("control", None)], "arm string, v double")
    got = S.welch_t(df, "v", "arm").first()
    va, vb = 5 / 3, 9.0
    t = (2.5 - 5.0) / math.sqrt(va / 4 + vb / 3)
    dof = (va / 4 + vb / 3) ** 2 / ((va / 4) ** 2 / 3 + (vb / 3) ** 2 / 2)
    assert close(got.welch_t, t) and close(got.df, dof)
    assert 0 < got.p_value < 1


def test_empty_arm_gives_null_not_an_error(spark):
    got = counted(spark, 0, 0, 10, 3)
    assert got.rate_treated is None and got.effect_pp is None and got.ci_lo is None


def test_certain_outcomes_have_a_zero_width_interval(spark):
    got = counted(spark, 10, 10, 10, 0)
    assert (got.effect_pp, got.ci_lo, got.ci_hi) == (100.0, 100.0, 100.0)


def test_chi2_of_a_one_sided_table_is_null(spark):
    df = spark.createDataFrame([("control", True), ("control", False)], "arm string, o boolean")
    assert S.chi2_2x2(df, "arm", "o").first().chi2 is None


def test_yates_never_goes_below_zero(spark):
    args = [F.lit(v) for v in (10, 5, 10, 5)]
    assert spark.range(1).select(S.yates_chi2(*args).alias("x")).first().x == 0.0


def frame(spark, rows):
    return spark.createDataFrame(
        rows,
        "variant string, converted boolean, n_items bigint, repeat_within_30d boolean,"
        " is_observable_30d boolean",
    )


def arms(spark, rows):
    counted = X.arm_statistics(frame(spark, rows), "variant", "n_items")
    return X.side_by_side(counted, "variant", "control", "treatment")


def test_intention_to_treat_keeps_lost_sessions(spark):
    rows = [("control", True, 3, True, True)] * 6 + [("control", True, 3, None, True)] * 4
    rows += [("treatment", True, 3, True, True)] * 3 + [("treatment", False, None, None, None)] * 7
    wide = arms(spark, rows)
    itt = X.readout(wide, "assigned").first()
    assert (itt.n_control, itt.n_treatment) == (10, 10)
    assert close(itt.effect_pp, -30.0)
    seen = X.readout(wide, "exposed").first()
    assert seen.n_treatment == 3 and close(seen.rate_treated, 1.0)


def test_without_losses_both_readouts_agree(spark):
    rows = [("control", True, 3, i % 2 == 0, True) for i in range(20)]
    rows += [("treatment", True, 4, i % 3 == 0, True) for i in range(20)]
    wide = arms(spark, rows)
    a, b = X.readout(wide, "assigned").first(), X.readout(wide, "exposed").first()
    assert a.effect_pp == b.effect_pp and a.p_value == b.p_value


def test_zero_conversions_in_one_arm(spark):
    rows = [("control", True, 3, True, True)] * 5 + [("treatment", False, None, None, None)] * 5
    got = X.conversion_effect(arms(spark, rows)).first()
    assert got.relative_loss == -1.0 and got.rate_treated == 0.0


def test_student_tail_over_all_degrees_of_freedom(monkeypatch):
    from orderlens.functions import tails

    for t in (0.01, 1.0, 4.0, 40.0):
        one = 2 / math.pi * math.atan2(1, t)
        assert tails.student_two_sided(t, 1) == pytest.approx(one, rel=1e-9)
        two = 2 / (2 + t * t + t * math.sqrt(2 + t * t))
        assert tails.student_two_sided(t, 2) == pytest.approx(two, rel=1e-9)
    # Both ways agree where they meet.
    for df in (3e4, 1e5, 1e6):
        for t in (0.1, 1.0, 3.0, 10.0, 30.0):
            through_normal, through_beta = [], []
            monkeypatch.setattr(tails, "NORMAL_FROM", 0)
            through_normal = tails.student_two_sided(t, df)
            monkeypatch.setattr(tails, "NORMAL_FROM", 1e300)
            through_beta = tails.student_two_sided(t, df)
            monkeypatch.undo()
            assert through_normal == pytest.approx(through_beta, rel=1e-9)
    for df in (1e8, 1e10, 1e12, 1e15):
        for t in (0.5, 1.0, 5.0):
            density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
            want = tails.normal_two_sided(t) + density * (t**3 + t) / (2 * df)
            assert tails.student_two_sided(t, df) == pytest.approx(want, rel=1e-9)


def test_tail_that_does_not_converge_is_refused(monkeypatch):
    from orderlens.functions import tails

    monkeypatch.setattr(tails, "STEPS", 3)
    with pytest.raises(ArithmeticError):
        tails.student_two_sided(3.0, 5000.0)


def test_critical_value():
    from orderlens.functions import tails

    assert tails.chi2_critical(0.001) == pytest.approx(10.827566170662733, rel=1e-12)
