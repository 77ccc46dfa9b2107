"""The split path must equal plain windows, whatever counts as hot."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderlens.operators.staging import first_per_key, stage_orders
from orderlens.operators.timeline import (
    hot_keys,
    hot_limit,
    ordered_columns,
    sequence,
    stored_cells,
)
from orderlens.params import Params

SCHEMA = "k string, t timestamp_ntz, id long, v int"


def sample(spark, seed):
    """One key with a third of the rows, bursts of equal times, NULL keys and times."""
    r = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else r.choice(["a", "b", "c", "d", None])
        burst = r.random() < 0.3
        when = start + dt.timedelta(hours=7 if burst else r.randrange(2000))
        rows.append((key, None if r.random() < 0.02 else when, i, r.choice([None, 1, 5, 9])))
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    w = Window.partitionBy("k").orderBy("t", "id")
    return df.select(
        "*",
        F.row_number().over(w).alias("seq"),
        F.count(F.lit(1)).over(Window.partitionBy("k")).alias("total"),
        F.lead("v").over(w).alias("next_v"),
        F.lag("t").over(w).alias("prev_t"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("top"),
    )


@pytest.mark.parametrize("hot, cell", [(10**6, 10**6), (50, 20), (10, 3), (1, 1)])
@pytest.mark.parametrize("seed", [1, 2])
def test_split_equals_plain_window(spark, rows, hot, cell, seed):
    df = sample(spark, seed)
    got = ordered_columns(
        df,
        ["k"],
        ["t", "id"],
        row_number="seq",
        total="total",
        lead={"next_v": "v"},
        lag={"prev_t": "t"},
        max_before={"top": "v"},
        hot_rows=hot,
        cell_rows=cell,
    )
    want = plain(df)
    assert rows(got, *want.columns) == rows(want)


def test_split_spreads_a_hot_key_over_partitions(spark):
    """With a third of the rows on one key, no window partition holds them all."""
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2026-01-01").cast("timestamp_ntz")).alias(
            "t"),
        "id",
    )
    got = ordered_columns(df, ["k"], ["t", "id"], row_number="seq", lead={"next_id": "id"},
                          hot_rows=5_000, cell_rows=1_000)
    hot = got.filter("k = 0")
    assert hot.select(F.max("seq"), F.count_distinct("seq")).first()[:] == (n // 3, n // 3)
    assert hot.filter("next_id - id <> 3").count() == 0
    assert hot.filter("next_id is null").count() == 1
    cells = stored_cells(df, hot_keys(df, ["k"], 5_000), ["k"], ["t", "id"], 1_000)
    sizes = [r["count"] for r in cells.groupBy("k", "_cell").count().collect()]
    assert sum(sizes) == n // 3 and max(sizes) <= 5_000 and len(sizes) >= 10


def test_cutting_is_skipped_only_when_no_key_is_large(spark, tmp_path):
    path = str(tmp_path / "counts")
    spark.createDataFrame([(1, 5), (2, 9)], "k int, n long").write.parquet(path)
    counts = spark.read.parquet(path)
    assert hot_limit(counts, "n", 9) is None
    assert hot_limit(counts, "n", 8) == 8
    assert hot_limit(counts, "n", None) is None


def largest_cell(df, order, hot, cell):
    cells = stored_cells(df, hot_keys(df, ["k"], hot), ["k"], order, cell)
    return cells.groupBy("k", "_cell").count().agg(F.max("count")).first()[0]


def test_a_burst_is_cut_again(spark):
    """A third of the rows within a minute, the others over ten years."""
    start = F.lit("2016-01-01").cast("timestamp_ntz")
    n = 30_000
    df = spark.range(n).select(
        F.lit("hot").alias("k"),
        F.timestamp_add(
            "SECOND",
            F.when(F.col("id") < n // 3, 1000 + F.col("id") % 60).otherwise(F.col("id") * 15_000),
            start,
        ).alias("t"),
        "id",
    )
    assert largest_cell(df, ["t", "id"], 1_000, 500) <= 1_000


@pytest.mark.parametrize("tie", ["id", "name"])
def test_rows_of_one_instant_are_cut_along_the_tie_breaker(spark, rows, tie):
    df = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.lit("2026-01-01 12:00:00").cast("timestamp_ntz").alias("t"),
        "id",
        F.concat(F.lit("ORDER-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"),
        (F.col("id") % 7).cast("int").alias("v"),
    )
    assert largest_cell(df, ["t", tie], 500, 100) <= 500
    got = ordered_columns(df, ["k"], ["t", tie], row_number="seq", lead={"next_v": "v"},
                          hot_rows=500, cell_rows=100)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("*", F.row_number().over(w).alias("seq"), F.lead("v").over(w).alias("next_v"))
    assert rows(got, *want.columns) == rows(want)


def test_text_of_any_bytes_keeps_its_order(spark, rows):
    names = ["", "a", "a\x00", "ab", "abc", "abd", "äb", "ä", "zz", "日本", "日", None, "a" * 40]
    df = spark.createDataFrame(
        [("k", n, i) for n in names for i in range(3)], "k string, name string, id long")
    got = ordered_columns(df, ["k"], ["name", "id"], row_number="seq", hot_rows=2, cell_rows=1)
    w = Window.partitionBy("k").orderBy("name", "id")
    assert rows(got) == rows(df.withColumn("seq", F.row_number().over(w)))


@pytest.mark.parametrize("seconds", [0, 1])
def test_a_batch_among_steady_rows_is_cut(spark, rows, seconds):
    """20,000 rows at one instant, or within a second, and as many over 90 days."""
    n = 20_000
    instant = F.lit("2026-02-01 12:00:00").cast("timestamp_ntz")
    batch = F.timestamp_add("MICROSECOND", F.col("id") % 1_000_000 * seconds, instant)
    steady = F.timestamp_add("SECOND", F.col("id") * 388, F.lit("2026-01-01").cast("timestamp_ntz"))
    df = spark.range(2 * n).select(
        F.lit("hot").alias("k"),
        F.when(F.col("id") < n, batch).otherwise(
            F.timestamp_add("SECOND", (F.col("id") - 2 * n) * 388, steady)).alias("t"),
        F.xxhash64("id").alias("id"),
        (F.col("id") % 7).cast("int").alias("v"),
    )
    assert largest_cell(df, ["t", "id"], 1_000, 250) <= 1_000
    got = ordered_columns(df, ["k"], ["t", "id"], row_number="seq", total="total",
                          lead={"next_v": "v"}, lag={"prev_t": "t"}, max_before={"top": "v"},
                          hot_rows=1_000, cell_rows=250)
    want = plain(df)
    assert rows(got, *want.columns) == rows(want)


def test_without_a_hot_key_the_plan_is_the_plain_window(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(1_000).selectExpr("id % 50 AS k", "id AS t").write.parquet(path)
    got = ordered_columns(spark.read.parquet(path), ["k"], ["t"], lead={"next": "t"},
                          hot_rows=100, cell_rows=10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_sequence_counts_days_between_orders(spark):
    df = spark.createDataFrame(
        [(1, 7, dt.datetime(2026, 1, 1, 23, 59)), (2, 7, dt.datetime(2026, 1, 2, 0, 1)),
         (3, 8, dt.datetime(2026, 1, 1, 1, 0))],
        "order_id long, customer_id long, ordered_at_gst timestamp_ntz",
    )
    got = {r.order_id: r for r in sequence(df, hot_rows=10, cell_rows=10).collect()}
    assert (got[1].order_seq, got[1].prior_order_count, got[1].days_to_next_order) == (1, 0, 1)
    assert got[2].days_to_next_order is None and got[2].customer_lifetime_orders == 2
    assert got[3].prev_ordered_at_gst is None


EVENTS = "order_id long, customer_id long, darkstore_id long, event_type string, " \
         "event_at_utc timestamp_ntz"


def test_retries_cancellations_and_orphans(spark):
    t = dt.datetime(2026, 1, 4, 20, 0)
    later = t + dt.timedelta(milliseconds=300)
    df = spark.createDataFrame(
        [
            (1, 10, 5, "order_placed", later),  # out of order: the retry comes first
            (1, 10, 5, "order_placed", t),
            (1, 10, 5, "order_placed", t),  # exact copy
            (2, 11, 5, "order_placed", t),
            (2, 11, 5, "order_cancelled", later),
            (2, 11, 5, "order_cancelled", later),
            (3, 12, 5, "order_cancelled", t),  # never placed
            (4, 13, 5, "order_placed", None),
            (4, 13, 6, "order_placed", t),
        ],
        EVENTS,
    )
    staged = {r.order_id: r for r in stage_orders(df, Params()).collect()}
    assert set(staged) == {1, 2, 4}
    assert staged[1].ordered_at_utc == t and not staged[1].is_cancelled
    assert staged[1].order_date_gst == dt.date(2026, 1, 5)
    assert staged[2].is_cancelled
    assert staged[4].darkstore_id == 6  # a known time comes before an unknown one
    first = first_per_key(df, ["order_id", "event_type"], ["event_at_utc", "darkstore_id"])
    assert first.count() == 5
    again = first_per_key(first, ["order_id", "event_type"], ["event_at_utc", "darkstore_id"])
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(
        map(tuple, first.collect()), key=repr)


def test_copies_collapse_before_the_exchange(spark):
    """The rank filter and the aggregation both run on the map side as well."""
    df = spark.range(100).select(
        (F.col("id") % 3).alias("order_id"), F.col("id").alias("customer_id"),
        (F.col("id") % 2).alias("darkstore_id"),
        F.concat(F.lit("order_placed"), F.substring(F.col("id").cast("string"), 9, 1)).alias(
            "event_type"),
        F.lit("2026-01-01").cast("timestamp_ntz").alias("event_at_utc"),
    )
    ranked = first_per_key(df, ["order_id"], ["event_at_utc", "customer_id"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    staged = stage_orders(df, Params())._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in staged and staged.count("Exchange") == 1
