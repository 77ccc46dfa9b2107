import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import neighbours
from orderlens.llm.common import read


def brute(ids, vectors, asks, count):
    out = {}
    for q in asks:
        scores = (vectors * vectors[ids.index(q)]).sum(axis=1)
        order = sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:count]
        out[q] = [(i, -s) for s, i in order]
    return out


def listed(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append((r[2], r[3]))
        assert r[1] == len(out[r[0]])
    return out


def test_query_recall_and_exact_scores(spark):
    from orderlens.llm.queries import callables

    folder = "/root/testdata/sf0.1"
    table = read(spark, folder, "embeddings").orderBy("vec_id").collect()
    ids = [r.vec_id for r in table]
    vectors = np.array([r.embedding for r in table], np.float64)
    got = listed(map(tuple, callables()["op7_projected_neighbours"](spark, folder).collect()))
    want = brute(ids, vectors, [i for i in ids if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    for q, found in got.items():
        assert len(found) == 20
        for i, s in found:
            assert s == pytest.approx((vectors[ids.index(i)] * vectors[ids.index(q)]).sum(), abs=1e-12)


def test_small_tables_are_exact_with_ties_and_bad_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 4)]) for i in range(60)]
    rows = [(i, v) for i, v in rows if any(v)]
    bad = [(100, None), (120, [0.0] * 4), (140, [1.0, None, 0.0, 0.0]), (160, [float("nan")] * 4)]
    bad += [(180, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (200, [1.0, 2.0]), (220, [])]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, embedding array<double>")
    df = df.withColumn("score", F.lit(1))
    got = listed(map(tuple, neighbours.search(df, F.col("vec_id") % 20 == 0, 8).collect()))
    ids = [i for i, _ in rows]
    assert got == brute(ids, np.array([v for _, v in rows]), [i for i in ids if i % 20 == 0], 8)


def test_a_large_group_of_equal_vectors(spark):
    df = spark.range(300).select(
        F.col("id").alias("vec_id"),
        F.when(F.col("id") < 200, F.array(F.lit(1.0), F.lit(0.0)))
        .otherwise(F.array(F.lit(0.5), F.col("id").cast("double")))
        .alias("embedding"),
    )
    got = listed(map(tuple, neighbours.search(df, F.col("vec_id") % 20 == 0, 5).collect()))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in got[100]] == [0, 1, 2, 3, 4]


def test_few_rows_and_empty_tables(spark):
    kinds = "vec_id long, embedding array<float>"
    got = neighbours.search(
        spark.createDataFrame([(0, [1.0]), (1, [2.0])], kinds), F.col("vec_id") % 20 == 0
    )
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 2.0)]
    for rows in ([], [(1, [1.0])], [(0, [1.0])]):
        got = neighbours.search(spark.createDataFrame(rows, kinds), F.col("vec_id") % 20 == 0)
        assert got.collect() == [] and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 4) == pytest.approx(15.5073, abs=1e-3)
