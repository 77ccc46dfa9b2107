"""Slowly changing dimensions: build versions, join as of a date, check ranges."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators.timeline import ordered_columns
from orderlens.params import Params

LIMITS = Params()


def scd2_from_changes(
    changes: DataFrame,
    key: Sequence[str],
    at: str,
    *,
    hot_rows: int | None = LIMITS.hot_rows,
    cell_rows: int = LIMITS.cell_rows,
) -> DataFrame:
    """Change log -> versions: a version ends where the next one of its key starts."""
    versions = ordered_columns(
        changes, key, [at], lead={"valid_to": at}, hot_rows=hot_rows, cell_rows=cell_rows
    )
    return versions.withColumnRenamed(at, "valid_from").withColumn(
        "is_current", F.col("valid_to").isNull()
    )


def check_no_overlap(
    dim: DataFrame,
    key: str,
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    tie: Sequence[str] = (),
    *,
    hot_rows: int | None = LIMITS.hot_rows,
    cell_rows: int = LIMITS.cell_rows,
) -> DataFrame:
    """Versions that start before an earlier version of their key has ended.

    One ordered pass instead of a self join: a version overlaps an earlier one
    exactly when it starts before the running maximum of the ends so far.
    """
    real = dim.filter(F.col(valid_from) < F.col(valid_to))
    marked = ordered_columns(
        real,
        [key],
        [valid_from, valid_to, *tie],
        max_before={"covered_until": valid_to},
        hot_rows=hot_rows,
        cell_rows=cell_rows,
    )
    return marked.filter(F.col(valid_from) < F.col("covered_until")).select(
        key, valid_from, valid_to, "covered_until"
    )


def overlapping_pairs(
    dim: DataFrame,
    key: str,
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    tie: Sequence[str] = (),
    *,
    hot_rows: int | None = LIMITS.hot_rows,
    cell_rows: int = LIMITS.cell_rows,
) -> DataFrame:
    """Every pair of versions of a key that are live on a common date, both named.

    ``_a`` starts first (ties by end, then by ``tie``). Versions are cut into islands at
    dates that no earlier version of the key reaches; only islands with an overlap go on.
    Each is swept in the order of its starts: a new version pairs with those still open, so
    the work is the versions plus the pairs, and a task holds only the open versions of
    one island.
    """
    order = [valid_from, valid_to, *tie]
    limits = {"hot_rows": hot_rows, "cell_rows": cell_rows}
    real = dim.filter(F.col(valid_from) < F.col(valid_to)).select(key, *order)
    covered = ordered_columns(real, [key], order, max_before={"_covered": valid_to}, **limits)
    opens = F.coalesce(F.col(valid_from) >= F.col("_covered"), F.lit(True))
    opened = covered.withColumn("_open", F.when(opens, F.col(valid_from)))
    island = ordered_columns(opened, [key], order, max_before={"_earlier": "_open"}, **limits)
    island = island.withColumn("_island", F.coalesce("_open", "_earlier"))
    several = island.filter(F.col("_open").isNull()).select(F.col(key).alias("_k"), F.col("_island").alias("_i"))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_island") == F.col("_i"))
    rows = island.join(several.distinct(), same, "left_semi").select(key, "_island", *order)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shown = [key] + [f"{n}_{side}" for side in "ab" for n in order]
    schema = f"{key} {kinds[key]}, " + ", ".join(
        f"{n}_{side} {kinds[n]}" for side in "ab" for n in order
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        open_versions: list[tuple] = []  # (end, version), the earliest end first
        at, found, seen = None, [], 0
        for batch in batches:
            kind = {f.name: f.type for f in batch.schema}
            types = [kind[key]] + [kind[n] for _ in "ab" for n in order]
            for name, begin, *version in zip(*(c.to_pylist() for c in batch.columns)):
                if (name, begin) != at:
                    at, open_versions = (name, begin), []
                while open_versions and open_versions[0][0] <= version[0]:
                    heapq.heappop(open_versions)
                found += [(name, *old, *version) for _, _, old in open_versions]
                seen += 1
                heapq.heappush(open_versions, (version[1], seen, version))
                if len(found) >= 10_000:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*found), types)), shown)
                    found = []
        if found:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*found), types)), shown)

    dealt = rows.repartition(key, "_island").sortWithinPartitions(key, "_island", *order)
    return dealt.mapInArrow(sweep, schema)


def asof_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    at: str,
    take: Sequence[str],
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    *,
    hot_rows: int | None = LIMITS.hot_rows,
    cell_rows: int = LIMITS.cell_rows,
) -> DataFrame:
    """Left join to the version live on a date, by one ordered pass over facts and versions.

    Facts and versions of a key are ordered by date, versions first; each fact carries the
    version that started last, and has none if that one has ended. The work is facts plus
    versions, where the keyed join compares every fact with every version of its key; use
    it where keys have many versions. Hot keys are cut along the dates. Versions of a key
    must not overlap (``check_no_overlap``); of two that do, the later start counts.
    """
    clash = set(take) & set(fact.columns)
    if clash:
        raise ValueError(f"columns on both sides of the join: {sorted(clash)}")
    version = F.struct(
        F.col(valid_from).alias("_from"), F.col(valid_to).alias("_to"), *[F.col(c) for c in take]
    )
    versions = dim.filter(F.col(valid_from) < F.col(valid_to)).select(
        F.col(key).alias("_key"),
        F.col(valid_from).alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(0).cast("bigint").alias("_tie"),
        version.alias("_version"),
    )
    dated = fact.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    facts = dated.select(
        F.col(key).alias("_key"),
        F.col(at).alias("_at"),
        F.lit(1).alias("_kind"),
        F.xxhash64(*fact.columns).alias("_tie"),
        F.struct(*fact.columns).alias("_fact"),
    )
    events = facts.unionByName(versions, allowMissingColumns=True)
    carried = ordered_columns(
        events,
        ["_key"],
        ["_at", "_kind", "_tie"],
        max_before={"_live": "_version"},
        hot_rows=hot_rows,
        cell_rows=cell_rows,
    ).filter("_kind = 1")
    live = F.col("_at") < F.col("_live._to")
    found = carried.select(
        *[F.col("_fact")[c].alias(c) for c in fact.columns],
        *[F.when(live, F.col("_live")[c]).alias(c) for c in take],
    )
    kinds = {f.name: f.dataType for f in found.schema.fields}
    undated = fact.filter(F.col(key).isNull() | F.col(at).isNull())
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in take]
    return found.unionByName(undated.select(*fact.columns, *nothing))


def most_versions(dim: DataFrame, key: str) -> int:
    """The largest number of versions that a key has."""
    return dim.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def scd2_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    at: str,
    take: Sequence[str],
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    fan_out_guard: bool = False,
    carry: bool = False,
) -> DataFrame:
    """Left join to the version live on a date; ranges are half-open.

    With ``carry`` the join is one ordered pass (``asof_join``), for keys of many versions.

    The equi key drives the join, the range is a residual. No broadcast hint: the
    planner broadcasts the dimension when its size allows, else it shuffles both
    sides and splits hot keys. With ``fan_out_guard`` an overlapping dimension
    key fails the query instead of multiplying rows.
    """
    if carry and not fan_out_guard:
        return asof_join(fact, dim, key, at, take, valid_from, valid_to)
    clash = set(take) & set(fact.columns)
    if clash:
        raise ValueError(f"columns on both sides of the join: {sorted(clash)}")
    versions = dim.select(
        F.col(key).alias("_key"),
        F.col(valid_from).alias("_from"),
        F.col(valid_to).alias("_to"),
        *take,
    )
    if fan_out_guard:
        bad = (
            check_no_overlap(dim, key, valid_from, valid_to)
            .select(F.col(key).alias("_bad"))
            .distinct()
        )
        versions = versions.join(bad, F.col("_key") == F.col("_bad"), "left").withColumn(
            "_from",
            F.when(F.col("_bad").isNull(), F.col("_from")).otherwise(
                F.raise_error(F.concat(F.lit(f"overlapping versions of {key} "), F.col("_key")))
            ),
        )
    live = (
        (F.col(key) == F.col("_key"))
        & (F.col(at) >= F.col("_from"))
        & (F.col(at) < F.col("_to"))
    )
    return fact.join(versions, live, "left").select(*fact.columns, *take)
