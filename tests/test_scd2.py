import datetime as dt
import random

import pytest

from orderlens.operators import checks
from orderlens.operators.scd2 import (
    asof_join,
    check_no_overlap,
    overlapping_pairs,
    scd2_from_changes,
    scd2_join,
)

D = dt.date
END = D(2999, 12, 31)
DIM = "pid int, price double, valid_from date, valid_to date"


def dim(spark, rows):
    return spark.createDataFrame(rows, DIM)


def fact(spark, *pairs):
    return spark.createDataFrame(list(pairs), "pid int, day date")


def test_order_on_the_change_date_takes_the_new_version(spark):
    versions = dim(spark, [(1, 1.0, D(2026, 1, 1), D(2026, 2, 1)), (1, 2.0, D(2026, 2, 1), END)])
    orders = fact(spark, (1, D(2026, 1, 31)), (1, D(2026, 2, 1)), (1, D(2025, 12, 31)), (9, END))
    got = scd2_join(orders, versions, "pid", "day", ["price"])
    assert {(r.pid, r.day): r.price for r in got.collect()} == {
        (1, D(2026, 1, 31)): 1.0,
        (1, D(2026, 2, 1)): 2.0,
        (1, D(2025, 12, 31)): None,
        (9, END): None,
    }


def test_gap_is_found_by_its_check(spark):
    versions = dim(spark, [(1, 1.0, D(2026, 1, 1), D(2026, 1, 10)), (1, 2.0, D(2026, 2, 1), END)])
    got = scd2_join(fact(spark, (1, D(2026, 1, 20))), versions, "pid", "day", ["price"])
    assert checks.check_version_found(got, "price").count() == 1


def test_overlap_is_found_and_guarded(spark):
    versions = dim(spark, [(1, 1.0, D(2026, 1, 1), D(2026, 3, 1)), (1, 2.0, D(2026, 2, 1), END),
                           (2, 1.0, D(2026, 1, 1), END)])
    found = check_no_overlap(versions, "pid").collect()
    assert [(r.pid, r.valid_from, r.covered_until) for r in found] == [
        (1, D(2026, 2, 1), D(2026, 3, 1))]
    orders = fact(spark, (1, D(2026, 2, 15)))
    assert scd2_join(orders, versions, "pid", "day", ["price"]).count() == 2
    with pytest.raises(Exception, match="overlapping versions"):
        scd2_join(orders, versions, "pid", "day", ["price"], fan_out_guard=True).collect()


def test_overlap_with_a_version_that_is_not_the_previous_one(spark):
    versions = dim(spark, [(1, 1.0, D(2026, 1, 1), END), (1, 2.0, D(2026, 2, 1), D(2026, 2, 5)),
                           (1, 3.0, D(2026, 3, 1), END)])
    assert check_no_overlap(versions, "pid").count() == 2
    assert check_no_overlap(versions, "pid", hot_rows=1, cell_rows=1).count() == 2


def test_adjacent_versions_do_not_overlap(spark):
    versions = dim(spark, [(1, 1.0, D(2026, 1, 1), D(2026, 2, 1)), (1, 2.0, D(2026, 2, 1), END)])
    assert check_no_overlap(versions, "pid").count() == 0


def test_versions_from_changes(spark):
    changes = spark.createDataFrame(
        [(1, 1.0, D(2026, 1, 1)), (1, 3.0, D(2026, 3, 1)), (1, 2.0, D(2026, 2, 1)),
         (2, 9.0, D(2026, 1, 1))], "pid int, price double, at date")
    for limits in ({}, {"hot_rows": 1, "cell_rows": 1}):
        got = scd2_from_changes(changes, ["pid"], "at", **limits)
        assert {(r.pid, r.price): (r.valid_from, r.valid_to, r.is_current)
                for r in got.collect()} == {
            (1, 1.0): (D(2026, 1, 1), D(2026, 2, 1), False),
            (1, 2.0): (D(2026, 2, 1), D(2026, 3, 1), False),
            (1, 3.0): (D(2026, 3, 1), None, True),
            (2, 9.0): (D(2026, 1, 1), None, True),
        }


def test_the_range_is_a_residual_of_one_keyed_join(spark):
    versions = dim(spark, [(1, 1.0, D(2026, 1, 1), END)])
    joined = scd2_join(fact(spark, (1, D(2026, 1, 2))), versions, "pid", "day", ["price"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_same_column_on_both_sides_is_refused(spark):
    versions = dim(spark, [(1, 1.0, D(2026, 1, 1), END)])
    with pytest.raises(ValueError):
        scd2_join(fact(spark, (1, D(2026, 1, 2))), versions, "pid", "day", ["pid"])


def brute_pairs(rows):
    out = []
    live = sorted((k, a, b, i) for i, (k, a, b) in enumerate(rows) if a < b)
    for x in range(len(live)):
        for y in range(x + 1, len(live)):
            (k, a, b, _), (m, c, d, _) = live[x], live[y]
            if k == m and c < b:
                out.append((k, a, b, c, d))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 20, "cell_rows": 7}])
def test_overlapping_pairs_equal_all_pairs(spark, limits):
    draw = random.Random(3)
    rows = []
    for _ in range(300):
        start = D(2026, 1, 1) + dt.timedelta(days=draw.randrange(2000))
        rows.append((draw.choice([1, 1, 1, 2, 3]), start, start + dt.timedelta(days=draw.randrange(40))))
    rows += [(4, D(2026, 1, 1), END)] + [(4, D(2026, 2, d), D(2026, 2, d + 1)) for d in range(1, 20)]
    dim = spark.createDataFrame([(*r, 1) for r in rows], "pid int, valid_from date, valid_to date, x int")
    got = overlapping_pairs(dim.repartition(3), "pid", **limits)
    assert got.columns == ["pid", "valid_from_a", "valid_to_a", "valid_from_b", "valid_to_b"]
    assert sorted(map(tuple, got.collect())) == brute_pairs(rows)
    assert overlapping_pairs(dim.limit(0), "pid").collect() == []


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 30, "cell_rows": 11}])
def test_asof_join_equals_the_keyed_join(spark, limits):
    draw = random.Random(5)
    rows, day = [], D(2026, 1, 1)
    for i in range(150):  # one key of many versions with gaps
        until = day + dt.timedelta(days=draw.randrange(0, 4))
        rows.append((1, float(i), day, until))
        day = until + dt.timedelta(days=draw.choice([0, 0, 1]))
    rows += [(2, 7.0, D(2026, 1, 5), END), (3, None, D(2026, 1, 5), END)]
    facts = [(draw.choice([1, 1, 1, 2, 3, 9]), D(2026, 1, 1) + dt.timedelta(days=draw.randrange(300))) for _ in range(400)]
    facts += [(1, D(2026, 2, 1))] * 60 + [(None, D(2026, 2, 1)), (1, None), (None, None), (1, D(2020, 1, 1))]
    left, versions = fact(spark, *facts), dim(spark, rows)
    want = sorted(map(repr, scd2_join(left, versions, "pid", "day", ["price"]).collect()))
    got = asof_join(left, versions, "pid", "day", ["price"], **limits)
    assert got.columns == ["pid", "day", "price"]
    assert sorted(map(repr, got.collect())) == want and len(want) == len(facts)
    assert sorted(map(repr, scd2_join(left, versions, "pid", "day", ["price"], carry=True).collect())) == want


def test_asof_join_meets_no_versions_in_a_join(spark):
    versions = dim(spark, [(1, 1.0, D(2026, 1, 1), END)])
    joined = asof_join(fact(spark, (1, D(2026, 1, 2))), versions, "pid", "day", ["price"], hot_rows=None)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" in plan
    with pytest.raises(ValueError):
        asof_join(fact(spark, (1, D(2026, 1, 2))), versions, "pid", "day", ["pid"])
