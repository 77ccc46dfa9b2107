import math
from collections import defaultdict

import numpy as np
import pytest

from orderlens.llm import whitening
from orderlens.llm.common import read
from orderlens.llm.queries import callables

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
draw = np.random.default_rng(5)


def exact(matrix, values, axes, least=1e-15):
    """Residual and orthonormality to double precision."""
    a, x = matrix.astype(np.longdouble), axes.astype(np.longdouble)
    size = np.abs(matrix).max()
    assert np.abs(a @ x - x * values).max() <= least * size
    assert np.abs(x.T @ x - np.eye(len(a))).max() <= least
    assert (np.diff(values) <= 0).all()
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], rtol=0, atol=1e-13 * size)


@pytest.mark.parametrize("dim", [1, 2, 7, 64, 130])
def test_eigenvectors_of_random_matrices(dim):
    rows = draw.normal(size=(3 * dim, dim))
    exact(rows.T @ rows, *whitening.eigen(rows.T @ rows))


@pytest.mark.parametrize(
    "values",
    [
        np.ones(40),
        np.r_[np.ones(15), np.full(25, 2.0)],
        np.r_[1 + 1e-9 * np.arange(20), 2 + 1e-11 * np.arange(20)],
        np.r_[1 + 1e-13 * np.arange(20), np.geomspace(1e-12, 1, 20)],
        np.r_[np.zeros(20), np.ones(20)],
        1e200 * np.arange(1, 41),
        1e-200 * np.arange(1, 41),
        np.zeros(40),
    ],
)
def test_eigenvectors_of_clustered_eigenvalues(values):
    turn = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    exact(matrix, *whitening.eigen(matrix))


def test_float32_alone_is_not_enough():
    turn = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    values = np.r_[1 + 1e-5 * np.arange(39), 5.0]
    matrix = (turn * values) @ turn.T
    own = whitening.eigen((matrix + matrix.T) / 2)[1]
    single = np.linalg.eigh(matrix.astype(np.float32))[1][:, ::-1]
    want = turn[:, ::-1]
    assert np.abs(np.abs((own * want).sum(axis=0)) - 1).max() < 1e-12
    assert np.abs(np.abs((single * want).sum(axis=0)) - 1).max() > 1e-6


def brute(vectors, count=32):
    """n, sums, exact deviations, eigenvalues, axes and trace from whole vectors."""
    x = np.floor(np.asarray(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    off = [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
    centred = np.array([[o / n for o in row] for row in off])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    return n, [sum(o * o for o in row) for row in off], centred, values[:count], axes[:, :count], np.trace(cov)


def check(rows, got, count=32):
    """Every row against brute force; whitened up to one sign for each component."""
    n, off, centred, values, axes, trace = brute([v for _, v in rows], count)
    want = defaultdict(list)
    for at, (key, _) in enumerate(rows):
        want[key].append(at)
    shown = min(count, centred.shape[1])
    assert len(got) == len(rows) * shown
    cells = defaultdict(list)
    for r in got:
        assert r.n == n
        cells[r.vec_id, r.component].append(r)
    signs = {}
    for (key, c), many in cells.items():
        assert sorted(r.deviation for r in many) == sorted(off[i] for i in want[key])
        assert len(many) == len(want[key])
        if values[c - 1] <= values[0] * 1e-12:
            assert all(r.whitened is None and r.explained == 0 for r in many)
            continue
        for r in many:
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9)
        if len(many) == 1:
            right = centred[want[key][0]] @ axes[:, c - 1] / math.sqrt(values[c - 1])
            if abs(right) > 1e-3:
                signs.setdefault(c, np.sign(right * many[0].whitened))
            assert many[0].whitened == pytest.approx(signs.get(c, 1) * right, abs=1e-7)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    table = read(spark, folder, "embeddings").collect()
    got = callables()["op12_whitening"](spark, folder)
    assert got.columns == COLUMNS and dict(got.dtypes)["deviation"] == "bigint"
    rows = got.collect()
    check([(r.vec_id, r.embedding) for r in table], rows)
    error = {r.identity_error for r in rows}
    assert len(error) == 1 and 0 <= error.pop() < 1e-10
    many = defaultdict(dict)
    for r in rows:
        many[r.vec_id][r.component] = r.whitened
    whole = np.array([[v[c] for c in range(1, 33)] for v in many.values()])
    cov = np.cov(whole.T, bias=True)
    assert np.abs(cov - np.eye(32)).max() < 1e-9


def table(spark, rows):
    kinds = "vec_id long, embedding array<float>, component string, n string, vector int, key int"
    return spark.createDataFrame([(i, v, "x", "y", 1, 2) for i, v in rows], kinds)


def test_bad_vectors_repeats_and_clashing_columns(spark):
    rows = [(i, [float(np.float32(c)) for c in draw.normal(size=5)]) for i in range(60)]
    rows += [rows[3], (7, rows[8][1]), (None, rows[9][1]), (500, [0.0] * 5)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] + [0.0] * 4)]
    bad += [(104, [float("inf")] + [0.0] * 4), (105, [1.0, 2.0]), (106, [1e30] + [0.0] * 4)]
    got = whitening.whiten(table(spark, rows + bad).repartition(5))
    assert got.columns == COLUMNS
    check(rows, got.collect())
    check(rows, whitening.whiten(table(spark, rows), 3).collect(), 3)


def test_dimensions_without_variance(spark):
    rows = [(i, [float(i), 1.0, -float(i)]) for i in range(10)]
    check(rows, whitening.whiten(table(spark, rows)).collect())
    same = whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10
    assert all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error is None for r in same)


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, [])]):
        got = whitening.whiten(table(spark, rows))
        assert got.columns == COLUMNS and got.collect() == []


def test_merged_moments_and_deviations_are_exact():
    x = draw.integers(-(2**50), 2**50, (90, 4))
    held = whitening.Moments.of(x[:1])
    for part in (x[1:20], x[20:21], x[21:]):
        other = whitening.Moments.of(part)
        held = held.add(whitening.Moments.read(*other.record(), True))
    assert held.n == 90 and [int(s) for s in held.total] == [sum(int(v) for v in c) for c in x.T]
    centred = np.array([[(90 * int(v) - int(s)) / 90 for v, s in zip(row, held.total)] for row in x])
    assert np.allclose(held.products, centred.T @ centred, rtol=1e-12)
    model = whitening.Whitening(90, tuple(int(s) for s in held.total), np.ones(4), np.eye(4), 4.0)
    assert model.deviations(x) == [sum((90 * int(v) - int(s)) ** 2 for v, s in zip(row, held.total)) for row in x]
