import random

import pytest
from pyspark.sql import functions as F

from orderlens.operators.ranks import before, value_ranks, with_rank


@pytest.fixture
def table(spark):
    draw = random.Random(4)
    values = [None, 1.0, 1.0, 2.0, -3.0, 7.5]
    rows = [(i, draw.choice(["a", "b", None]), draw.choice(values)) for i in range(300)]
    rows += [(300 + i, "a", 2.0) for i in range(400)]  # a hot value
    return rows, spark.createDataFrame(rows, "id long, g string, x double")


@pytest.mark.parametrize("cell_rows", [7, 1_000_000])
def test_before_counts_rows_of_the_group(table, cell_rows):
    rows, df = table
    got = before(df, ["id"], "seen", by=["g"], total="n", cell_rows=cell_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.seen == sum(1 for i, g, _ in rows if g == r.g and i < r.id)
        assert r.n == sum(1 for _, g, _ in rows if g == r.g)


@pytest.mark.parametrize("cell_rows", [2, 1_000_000])
def test_value_ranks_and_mid_ranks(table, cell_rows):
    rows, df = table
    for by in ([], ["g"]):
        got = with_rank(df, "x", "place", by=by, descending=True, cell_rows=cell_rows).collect()
        mid = with_rank(df, "x", "place", by=by, mid=True, cell_rows=cell_rows).collect()
        assert len(got) == len(mid) == len(rows)
        for r, m in zip(sorted(got), sorted(mid)):
            near = [x for _, g, x in rows if x is not None and (not by or g == r.g)]
            if r.x is None:
                assert r.place is None and m.place is None
                continue
            assert r.place == 1 + sum(x > r.x for x in near)
            assert m.place == sum(x < m.x for x in near) + (near.count(m.x) + 1) / 2
    assert value_ranks(df.limit(0), "x", "place").collect() == []


def test_cells_hold_no_hot_value(table):
    from orderlens.operators.ranks import cells

    _, df = table
    counted = df.groupBy("x").count()
    assert max(r["count"] for r in cells(counted, [], ["x"], 2).groupBy("_cell").count().collect()) <= 3


@pytest.mark.parametrize("cell_rows", [3, 1_000_000])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_selected_percentiles_equal_the_merged_ones(table, cell_rows, by):
    from orderlens.operators.quantiles import exact_percentiles, quantile_bucket, quantile_profile

    _, df = table
    points = [0.0, 0.1, 0.25, 0.5, 0.731, 0.99, 1.0]
    got = sorted(map(repr, exact_percentiles(df, "id", points, by, cell_rows=cell_rows).collect()))
    want = exact_percentiles(df, "id", points, by).collect()
    assert got == sorted(map(repr, want)) and len(got) == (3 if by else 1)
    cut = quantile_bucket(df, "x", 4, "b", by, cell_rows=cell_rows)
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, quantile_bucket(df, "x", 4, "b", by).collect()))
    if by:
        shown = quantile_profile(df, "x", by, cell_rows=cell_rows)
        assert sorted(map(repr, shown.collect())) == sorted(map(repr, quantile_profile(df, "x", by).collect()))


def test_selection_on_an_empty_table(spark):
    from orderlens.operators.quantiles import exact_percentiles

    empty = spark.createDataFrame([], "g string, x double")
    assert exact_percentiles(empty, "x", [0.5], cell_rows=5).collect()[0][0] == [None]
    assert exact_percentiles(empty, "x", [0.5], ["g"], cell_rows=5).collect() == []


def test_robust_statistics_by_cells(table):
    from orderlens.operators.outliers import mad_outliers

    _, df = table
    plain = mad_outliers(df, "id", "id", 1.0).collect()
    assert sorted(mad_outliers(df, "id", "id", 1.0, cell_rows=20).collect()) == sorted(plain)


def test_rank_matches_and_spearman_by_cells(spark):
    from orderlens.operators.scoring import rank_matches
    from orderlens.operators.stats import spearman

    draw = random.Random(7)
    rows = [(i, float(draw.randrange(9)), draw.randrange(20)) for i in range(200)]
    a = spark.createDataFrame([(i, x) for i, x, _ in rows], "k long, e double")
    b = spark.createDataFrame([(i, y) for i, _, y in rows], "k long, v long")
    few, many = rank_matches(a, b, "k", "e", "v"), rank_matches(a, b, "k", "e", "v", cell_rows=13)
    assert few.columns == many.columns and sorted(few.collect()) == sorted(many.collect())
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert {r.k: r.estimated_rank for r in many.collect()} == {r[0]: i for i, r in enumerate(order, 1)}
    assert not few.first().order_recovered
    assert rank_matches(a, a.toDF("k", "v"), "k", "e", "v", cell_rows=13).first().order_recovered
    both = a.join(b, "k")
    one, two = spearman(both, "e", "v").first(), spearman(both, "e", "v", cell_rows=13).first()
    assert one.n_groups == two.n_groups == 200 and one.rho == pytest.approx(two.rho, abs=1e-12)


def test_no_window_over_one_group(spark):
    """Read-outs over few groups use arrays; those over many use cells."""
    from orderlens.operators import effects, scoring, stats

    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "k string, n string, v double")
    for out in (
        scoring.rank_matches(df.select("k", "v"), df.select("k", F.col("v").alias("w")), "k", "v", "w"),
        effects.ranking_stability(df, "k", "n", "v"),
        stats.spearman(df, "v", "v"),
    ):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        keys = [line.split("], [")[1].split("#")[0] for line in plan.splitlines() if "Window [" in line]
        assert set(keys) <= {"k"}, keys
