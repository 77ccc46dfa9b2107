"""Approximate nearest neighbours: stable projections in a kd-tree, chi-square stopping.

Vectors are cut into blocks of rows; each block is indexed whole by a kd-tree over
PROJECTED Gaussian (2-stable) projections. Largest inner product becomes smallest
distance by one more coordinate that gives all vectors the same length. A query reads the
leaves in the order of their projected distance and computes the exact inner product of
every vector there. For a vector at true distance d the squared projected distance over
d squared follows a chi-square law with PROJECTED degrees of freedom; the search of a
block stops when it is at least CERTAIN that no unread vector is nearer than the worst
of the found ones. A bounded sample of the vectors gives a first bound on that distance.

Blocks of rows meet blocks of queries in tasks of their own, so no task holds more than
two blocks. Equal vectors are one vector; of its ids the smallest count + 1 are kept,
which are all that any answer can contain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import groups, stored, tasks

SEED = 3
PROJECTED = 8
LEAF = 256
CERTAIN = 0.97
ROW_BLOCK, QUERY_BLOCK = 32768, 16384
LEAST_BLOCK = 2048
SAMPLE = 4096  # vectors that give the first bound


def chi_square_quantile(p: float, half: int) -> float:
    """Of 2 * half degrees of freedom, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return (low + high) / 2


@lru_cache
def stopping_ratio(certain: float) -> float:
    """The quantile of the stopping test, computed once in each task's process."""
    return chi_square_quantile(certain, PROJECTED // 2)


def usable(vector: Column) -> Column:
    """Not null, not zero, every component there and finite."""
    plain = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(plain & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tree:
    """A block's vectors in leaf order, the boxes of the leaves in projected space."""

    def __init__(self, vectors: np.ndarray, reach: float) -> None:
        extra = np.sqrt(np.maximum(0, reach**2 - (vectors**2).sum(axis=1)))
        draw = np.random.default_rng(SEED)
        self.axes = draw.standard_normal((vectors.shape[1] + 1, PROJECTED))
        low = vectors @ self.axes[:-1] + extra[:, None] * self.axes[-1]
        parts, done = [np.arange(len(vectors))], []
        while parts:
            part = parts.pop()
            spread = np.ptp(low[part], axis=0)
            if len(part) <= LEAF or not spread.any():
                done += [part[i : i + LEAF] for i in range(0, len(part), LEAF)]
                continue
            half = len(part) // 2
            order = np.argpartition(low[part, spread.argmax()], half)
            parts += [part[order[:half]], part[order[half:]]]
        self.order = np.concatenate(done)
        self.vectors = vectors[self.order]
        self.edges = np.concatenate([[0], np.cumsum([len(p) for p in done])])
        self.least = np.stack([low[p].min(axis=0) for p in done])
        self.most = np.stack([low[p].max(axis=0) for p in done])

    def nearest(
        self, query: np.ndarray, count: int, reach: float, bound: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """Positions and inner products of the best ``count`` found; best first.

        ``bound`` is an inner product that ``count`` vectors of the whole table reach.
        """
        low = query @ self.axes[:-1]
        gap = np.maximum(np.maximum(self.least - low, low - self.most), 0)
        far = (gap**2).sum(axis=1)
        leaves = np.argsort(far, kind="stable")
        size, limit = float(query @ query), stopping_ratio(CERTAIN)
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(leaves), 4):
            worst = max(bound, scores[-1] if len(scores) == count else -np.inf)
            if worst > -np.inf:
                away = size + reach**2 - 2 * worst
                if far[leaves[at]] >= limit * max(away, 0) and at:
                    break
            rows = np.concatenate(
                [np.arange(self.edges[i], self.edges[i + 1]) for i in leaves[at : at + 4]]
            )
            near = self.vectors[rows] @ query
            rows, near = np.concatenate([found, rows]), np.concatenate([scores, near])
            if len(rows) > count:
                keep = np.argpartition(-near, count - 1)[:count]
                rows, near = rows[keep], near[keep]
            order = np.argsort(-near, kind="stable")
            found, scores = rows[order], near[order]
        # Once more row by row: equal for equal rows, wherever they stand.
        exact = (self.vectors[found] * query).sum(axis=1)
        return self.order[found], exact


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def search(
    table: DataFrame,
    is_query: Column,
    count: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest vectors of each query, its own row left out.

    Nearness is the largest inner product in double precision, ties go to the smaller
    id. Rows whose vector is null, zero or has a null or non-finite component take no
    part, nor do null ids and vectors of another length than the most frequent one (the
    smaller of equally frequent). Repeated rows count once. A query with fewer others
    than ``count`` gets all of them. Other columns are not looked at.
    """
    spark = table.sparkSession
    plain = table.select(
        F.col(key).alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    plain = plain.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = plain.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    most = lengths.orderBy(F.desc("rows"), "n").first()
    kind = plain.schema["id"].dataType.simpleString()
    empty = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if most is None:
        return spark.createDataFrame([], empty)
    plain = plain.filter(F.size("vector") == most["n"])
    plain = stored(plain.withColumn("print", F.xxhash64("vector")), "vectors")

    few = Window.partitionBy("print", "vector").orderBy("id")
    ids = plain.select("print", "vector", "id").distinct()
    ids = ids.withColumn("place", F.row_number().over(few)).filter(F.col("place") <= count + 1)
    base = ids.groupBy("print", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    base = stored(base, "base")
    asked = plain.filter("asks").select("print", "vector", "id").distinct()
    # One row per different query vector; the smallest id names it.
    named = asked.groupBy("print", "vector").agg(F.min("id").alias("name"))
    named = stored(named, "queries")
    rows, queries = base.count(), named.count()
    if not queries:
        return spark.createDataFrame([], empty)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    reach = math.sqrt(base.agg(F.max(norm)).first()[0]) * (1 + 1e-9)
    sample = base.orderBy(F.xxhash64("print"), "vector").limit(SAMPLE)
    held = sample.select("vector", F.size("ids").alias("n")).toArrow()
    known, weights = _matrix(held.column(0)), held.column(1).to_numpy()

    row_blocks = max(-(-rows // ROW_BLOCK), min(tasks(spark), -(-rows // LEAST_BLOCK)))
    query_blocks = -(-queries // QUERY_BLOCK)
    home = F.pmod(F.xxhash64("print", F.lit(1)), F.lit(row_blocks))
    group = F.pmod(F.xxhash64("print", F.lit(2)), F.lit(query_blocks))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    every_home = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    left = base.select(
        home.alias("home"), every_group.alias("group"), F.lit(0).alias("asks"), "vector", "ids"
    )
    right = named.select(
        every_home.alias("home"),
        group.alias("group"),
        F.lit(1).alias("asks"),
        "vector",
        F.array("name").alias("ids"),
    )
    cells = left.unionByName(right).withColumn(
        "cell", F.col("home").cast("bigint") * query_blocks + F.col("group")
    )

    def first_bounds(asking: np.ndarray) -> np.ndarray:
        """Per query an inner product that more than ``count`` vectors reach."""
        out = np.full(len(asking), -np.inf)
        for at in range(0, len(asking), 512):
            near = asking[at : at + 512] @ known.T
            order = np.argsort(-near, axis=1)
            enough = (np.cumsum(weights[order], axis=1) > count).argmax(axis=1)
            reached = np.take_along_axis(near, order, axis=1)[np.arange(len(near)), enough]
            full = weights.sum() > count
            out[at : at + 512] = reached - 1e-9 * abs(reached) if full else -np.inf
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, "cell"):
            asks = cell.column("asks").to_numpy()
            if asks.all() or not asks.any():
                continue
            own, asking = cell.filter(pa.array(asks == 0)), cell.filter(pa.array(asks == 1))
            tree = Tree(_matrix(own.column("vector")), reach)
            owners = own.column("ids").to_pylist()
            wanted = _matrix(asking.column("vector"))
            names = asking.column("ids").to_pylist()
            out = []
            for name, query, bound in zip(names, wanted, first_bounds(wanted)):
                got, scores = tree.nearest(query, count + 1, reach, bound)
                found = [(-s, i) for g, s in zip(got, scores.tolist()) for i in owners[g]]
                out += [(name[0], i, -s) for s, i in sorted(found)[: count + 1]]
            columns = list(zip(*out))
            number = cell.schema.field("ids").type.value_type
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], number),
                    pa.array(columns[1], number),
                    pa.array(columns[2], pa.float64()),
                ],
                ["name", "vec_id", "score"],
            )

    found = (
        cells.select("cell", "asks", "vector", "ids")
        .repartition(max(tasks(spark), row_blocks * query_blocks), "cell")
        .sortWithinPartitions("cell")
        .mapInArrow(run, f"name {kind}, vec_id {kind}, score double")
    )
    best = Window.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= count + 1)
    askers = asked.join(named, ["print", "vector"]).select(F.col("id").alias("query_id"), "name")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = (
        askers.join(found, "name")
        .filter("vec_id != query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(own))
    )
    return ranked.filter(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")
