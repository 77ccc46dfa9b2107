"""Sources, sinks, joins, checks, scoring and drift on small literal tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from orderlens.operators import checks, metrics, outliers, scoring
from orderlens.operators import joins as J
from orderlens.params import Params
from orderlens.plans.warehouse import Warehouse
from orderlens.sources import raw, swap, tables

D = dt.date


def write_sources(spark, folder):
    made = {}
    t = dt.datetime(2026, 1, 5, 9, 30, 15, 250000)
    values = {
        "raw_customers": [("c1", "Fresh", D(2025, 1, 1), "s1", False)],
        "raw_products": [("p1", None, 4.5, D(2026, 1, 1), None, True)],
        "raw_darkstores": [("s1", "One, north", "A", 1.2, D(2024, 1, 1), 2.5, D(2024, 1, 1),
                            None, True)],
        "raw_order_events": [("o1", "c1", "s1", "order_placed", t)],
        "raw_order_items": [("o1", "p1", 2, True, False, None)],
        "raw_fulfilment_events": [("o1", t, t + dt.timedelta(minutes=61), True, False, False,
                                   None)],
        "raw_sessions": [("x1", "c1", True, "o1", t), ("x2", "c1", False, None, t)],
        "raw_experiment_assignments": [("x1", "c1", "control", t)],
    }
    for name, rows in values.items():
        made[name] = spark.createDataFrame(rows, raw.SCHEMAS[name])
        raw.write_csv(made[name], folder, name)
    return made


def test_landing_is_a_faithful_typed_copy(spark, tmp_path, rows):
    made = write_sources(spark, str(tmp_path / "src"))
    (tmp_path / "src" / "_truth_test_accounts.csv").write_text("customer_id\nc1\n")
    landed = raw.land_raw(spark, str(tmp_path / "src"), str(tmp_path / "raw"))
    assert set(landed) == set(raw.SOURCES)
    for name, df in landed.items():
        assert df.schema.simpleString() == made[name].schema.simpleString()
        assert rows(df) == rows(made[name])
    assert not (tmp_path / "raw" / "_truth_test_accounts").exists()
    counts = {r.table_name: r.n_rows for r in raw.landing_counts(landed).collect()}
    assert counts["raw_sessions"] == 2 and len(counts) == 8
    assert {r.owner for r in raw.source_catalog(spark, landed).collect()} >= {"CRM", "ops"}


def test_missing_source_fails_before_landing(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="raw_sessions"):
        raw.land_raw(spark, str(tmp_path), str(tmp_path / "raw"))
    assert not (tmp_path / "raw").exists()
    with pytest.raises(KeyError):
        raw.read_raw(spark, str(tmp_path), "_truth_test_accounts")


def test_bad_value_fails_the_read(spark, tmp_path):
    folder = tmp_path / "raw_customers.csv"
    folder.mkdir()
    (folder / "part.csv").write_text(
        "customer_id,segment,acquired_on,home_darkstore_id,is_test_account\nc,s,not a day,h,x\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        raw.read_raw(spark, str(tmp_path), "raw_customers").collect()


def test_export_with_offsets_and_capitals(spark, tmp_path):
    """The way a data-frame library writes UTC instants, booleans and gaps."""
    (tmp_path / "raw_order_events.csv").write_text(
        "order_id,customer_id,darkstore_id,event_type,event_at_utc\n"
        "O1,C1,DS1,order_placed,2026-01-04 20:00:00+00:00\n"
        "O1,C1,DS1,order_placed,2026-01-04 20:00:00.250000+00:00\n"
        "O2,C1,DS1,order_placed,2026-03-08T02:30:00Z\n"
        "O3,C1,DS1,order_placed,2026-01-05 00:00:00+04:00\n"
        "O4,C1,DS1,order_placed,2026-03-08 02:30:00\n")
    (tmp_path / "raw_sessions.csv").write_text(
        "session_id,customer_id,converted,order_id,started_at_utc\n"
        "S1,C1,True,O1,2026-01-04 19:50:00+00:00\nS2,C1,False,,2026-01-04 19:50:00+00:00\n")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        events = raw.read_raw(spark, str(tmp_path), "raw_order_events")
        got = [(r.order_id, r.event_at_utc) for r in events.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    night = dt.datetime(2026, 1, 4, 20, 0)
    gap = dt.datetime(2026, 3, 8, 2, 30)  # does not exist in that session zone
    assert got == [("O1", night), ("O1", night + dt.timedelta(milliseconds=250)), ("O2", gap),
                   ("O3", night), ("O4", gap)]
    sessions = raw.read_raw(spark, str(tmp_path), "raw_sessions").collect()
    assert [(r.converted, r.order_id) for r in sessions] == [(True, "O1"), (False, None)]


def test_header_that_does_not_fit_fails(spark, tmp_path):
    (tmp_path / "raw_sessions.csv").write_text(
        "customer_id,session_id,converted,order_id,started_at_utc\nC1,S1,True,O1,2026-01-04\n")
    with pytest.raises(Exception, match="header|Header"):
        raw.read_raw(spark, str(tmp_path), "raw_sessions").collect()


def test_warehouse_from_landed_files(spark, tmp_path):
    write_sources(spark, str(tmp_path / "src"))
    landed = raw.land_raw(spark, str(tmp_path / "src"), str(tmp_path / "raw"))
    w = Warehouse(spark, landed, Params(), str(tmp_path / "marts"))
    order = w["fct_orders"].first()
    assert order.gross_value_aed == 9.0 and order.is_late_arriving
    assert order.store_age_days_at_order == 735 and not order.is_clean_order
    sessions = {r.session_id: r for r in w["fct_sessions"].collect()}
    assert sessions["x1"].is_in_experiment and sessions["x1"].gross_value_aed == 9.0
    assert not sessions["x2"].is_in_experiment and sessions["x2"].order_id is None
    stored = tables.read_mart(spark, str(tmp_path / "marts"), "dim_product").first()
    assert stored.category == "Unmapped" and stored.valid_to == D(2999, 12, 31)
    # A MAD of zero gives no threshold, hence no flag.
    account = w["int_test_accounts"].first()
    assert account.threshold is None and account.is_test_account is None
    assert w["dim_customer"].first().is_test_account is False
    w.register_views()
    assert spark.sql("SELECT count(*) AS n FROM stg_sessions JOIN fct_orders USING (order_id)"
                     ).first().n == 1


def test_partitioned_facts_equal_plain_ones(spark, tmp_path, rows):
    write_sources(spark, str(tmp_path / "src"))
    landed = raw.land_raw(spark, str(tmp_path / "src"), str(tmp_path / "raw"))
    plain = Warehouse(spark, landed, Params(), str(tmp_path / "plain"))
    dated = Warehouse(spark, landed, Params(), str(tmp_path / "dated"), partitioned=True)
    for name in ("fct_order_items", "fct_orders", "fct_customer_orders", "fct_sessions"):
        assert dated[name].schema.simpleString() == plain[name].schema.simpleString()
        assert rows(dated[name]) == rows(plain[name])
    assert (tmp_path / "dated" / "fct_orders" / "order_date_gst=2026-01-05").exists()
    with pytest.raises(KeyError):
        plain["no_such_table"]


def days(spark, rows):
    return spark.createDataFrame(rows, "day date, id int")


def test_lookback_replaces_recent_days_only(spark, tmp_path):
    path = str(tmp_path / "fact")
    tables.write_fact(days(spark, [(D(2026, 1, d), 1) for d in (1, 2, 3)]), path, "day", ["id"])
    again = days(spark, [(D(2026, 1, d), i) for d in (1, 2, 3) for i in (1, 2)])
    tables.overwrite_lookback(again, path, "day", 2)
    got = {r.day: r.n for r in
           spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n")).collect()}
    assert got == {D(2026, 1, 1): 1, D(2026, 1, 2): 2, D(2026, 1, 3): 2}
    tables.write_fact(days(spark, [(D(2026, 1, 9), 1)]), path, "day")
    assert spark.read.parquet(path).count() == 1


def test_lookback_removes_a_recent_day_without_rows(spark, tmp_path):
    path = str(tmp_path / "fact")
    tables.write_fact(days(spark, [(D(2026, 1, d), d) for d in (1, 2, 3, 4)]), path, "day")
    again = days(spark, [(D(2026, 1, 1), 9), (D(2026, 1, 3), 9)])
    tables.overwrite_lookback(again, path, "day", 2)
    got = sorted((r.day.day, r.id) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1), (3, 9), (4, 4)]  # a date after the newest one is not the run's
    tables.overwrite_lookback(again.limit(0), path, "day", 2)
    assert spark.read.parquet(path).count() == 3
    # A run that knows its date covers days without any row.
    tables.overwrite_lookback(again, path, "day", 2, newest=D(2026, 1, 4))
    assert stored_days(spark, path) == [(1, 1), (3, 9)]


def stored_days(spark, path):
    return sorted((r.day.day, r.id) for r in spark.read.parquet(path).collect())


def test_lookback_of_an_older_run_keeps_newer_days(spark, tmp_path):
    path = str(tmp_path / "fact")
    tables.write_fact(days(spark, [(D(2026, 1, d), d) for d in range(1, 11)]), path, "day")
    late = days(spark, [(D(2026, 1, d), 100 + d) for d in range(1, 5)])
    swapped = tables.overwrite_lookback(late, path, "day", 2)
    assert swapped == (D(2026, 1, 2), D(2026, 1, 4))
    want = [(1, 1), (2, 2), (3, 103), (4, 104), *[(d, d) for d in range(5, 11)]]
    assert stored_days(spark, path) == want
    assert os.listdir(f"{path}/_swaps") == []


def test_rows_without_a_date_fail_and_change_nothing(spark, tmp_path):
    path = str(tmp_path / "fact")
    tables.write_fact(days(spark, [(D(2026, 1, 1), 1)]), path, "day")
    for newest in (None, D(2026, 1, 1)):
        with pytest.raises(ValueError, match="without a date"):
            tables.overwrite_lookback(days(spark, [(D(2026, 1, 1), 2), (None, 3)]), path, "day", 2, newest=newest)
    assert stored_days(spark, path) == [(1, 1)]


@pytest.mark.parametrize("dies_at", ["decide", "first move", "second move", "third move"])
def test_lookback_that_dies(spark, tmp_path, monkeypatch, dies_at):
    """Before the manifest nothing has changed; after it the next run finishes the swap."""
    path = str(tmp_path / "fact")
    tables.write_fact(days(spark, [(D(2026, 1, d), d) for d in range(1, 6)]), path, "day")
    before = stored_days(spark, path)
    late = days(spark, [(D(2026, 1, 3), 13), (D(2026, 1, 5), 15)])
    moves = []
    move = swap._move

    def failing(session, old, new):
        if not old.endswith("draft"):
            moves.append(old)
        if dies_at == "decide" or len(moves) > ["first move", "second move", "third move"].index(dies_at):
            raise KeyboardInterrupt
        move(session, old, new)

    monkeypatch.setattr(swap, "_move", failing)
    with pytest.raises(KeyboardInterrupt):
        tables.overwrite_lookback(late, path, "day", 3)
    monkeypatch.setattr(swap, "_move", move)
    if dies_at in ("decide", "first move"):
        assert stored_days(spark, path) == before
    swap.finish_swaps(spark, path)
    after = [(1, 1), (2, 2), (3, 13), (5, 15)]
    assert stored_days(spark, path) == (before if dies_at == "decide" else after)
    swap.finish_swaps(spark, path)  # finding nothing to do changes nothing
    tables.overwrite_lookback(late, path, "day", 3)
    assert stored_days(spark, path) == after


def test_lookback_evaluates_its_rows_once(spark, tmp_path):
    path, seen = str(tmp_path / "fact"), spark.sparkContext.accumulator(0)
    tables.write_fact(days(spark, [(D(2026, 1, 1), 1)]), path, "day")

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    late = days(spark, [(D(2026, 1, d), d) for d in (1, 2, 3)]).coalesce(1)
    tables.overwrite_lookback(late.mapInArrow(count, late.schema), path, "day", 2)
    assert seen.value == 3


def test_published_table_is_replaced_when_complete(spark, tmp_path):
    path = str(tmp_path / "mart")
    swap.publish(days(spark, [(D(2026, 1, 1), 1)]), path)
    broken = days(spark, [(D(2026, 1, 2), 2)]).withColumn("id", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        swap.publish(broken, path)
    assert stored_days(spark, path) == [(1, 1)]
    assert [tuple(r) for r in swap.publish(days(spark, [(D(2026, 1, 3), 3)]), path).collect()] == [(D(2026, 1, 3), 3)]


def test_date_filter_reads_one_partition(spark, tmp_path):
    path = str(tmp_path / "fact")
    tables.write_fact(days(spark, [(D(2026, 1, d), d) for d in range(1, 9)]), path, "day")
    one = spark.read.parquet(path).filter(F.col("day") == D(2026, 1, 3))
    assert one.select("id").collect()[0].id == 3
    assert len(one.inputFiles()) == 8  # all files are known
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_metric_rows_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("new", 1.5, 1.0, 2.0, 10)],
                               "g string, e double, lo double, hi double, n long")
    long = metrics.metric_rows(df, "s", {"effect": "e", "width": "hi"}, F.col("g"), "lo", "hi", "n")
    for fmt in ("json", "parquet"):
        tables.write_metrics(long, str(tmp_path / fmt), fmt)
        assert rows(tables.read_metrics(spark, str(tmp_path / fmt), fmt)) == rows(long)
    assert rows(long)[1][3:] == (2.0, None, None, 10)


def test_drift_names_added_removed_and_changed(spark):
    schema = "section string, metric string, by string, value double"
    old = spark.createDataFrame([("s", "a", "x", 1.0), ("s", "b", "x", 1.0), ("s", "c", "x", None),
                                 ("s", "e", "x", None)], schema)
    new = spark.createDataFrame([("s", "a", "x", 1.1), ("s", "d", "x", 1.0), ("s", "c", "x", None),
                                 ("s", "e", "x", 2.0)], schema)
    got = {r.metric: r.status for r in metrics.metrics_drift(old, new).collect()}
    assert got == {"a": "changed", "b": "removed", "d": "added", "e": "changed"}
    near = {r.metric for r in metrics.metrics_drift(old, new, tol=0.2).collect()}
    assert near == {"b", "d", "e"}
    assert metrics.metrics_drift(old, old).count() == 0


def test_sparse_join_equals_a_left_join(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, None)], "i int, k string")
    right = spark.createDataFrame([("a", 7), (None, 8)], "k string, v int")
    assert rows(J.left_join_sparse(left, right, "k"), "i", "k", "v") == rows(
        left.join(right, "k", "left"), "i", "k", "v")


def test_null_keys_spread_over_the_shuffle(spark):
    n = 4_000
    left = spark.range(n).select("id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("k"))
    right = spark.range(0, n, 4).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1",
               "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        joined = J.left_join_sparse(left, right, "k")
        assert "_part" in joined._jdf.queryExecution().executedPlan().toString().split(
            "hashpartitioning(", 1)[1].split(")")[0]
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < n / 2  # three quarters of the rows have no key
        assert joined.filter("k IS NOT NULL AND v = 2 * k").count() == n // 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_scalars_refuse_a_second_row(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    one = J.with_scalars(df, df.agg(F.max("x").alias("m"), F.min("x").alias("l")))
    assert sorted(tuple(r) for r in one.collect()) == [(1, 2, 1), (2, 2, 1)]
    with pytest.raises(Exception):
        J.with_scalars(df, df.withColumnRenamed("x", "m")).collect()


def test_missing_days_become_visible(spark):
    df = spark.createDataFrame([("a", D(2026, 1, 1), 5), ("b", D(2026, 1, 3), 6)],
                               "s string, day date, n int")
    cal = spark.createDataFrame([(D(2026, 1, d),) for d in (1, 2, 3)], "day date")
    got = {(r.s, r.day.day): r.n for r in J.densify(df, cal, "day", ["s"], ["n"]).collect()}
    assert got == {("a", 1): 5, ("a", 2): 0, ("a", 3): 0, ("b", 1): 0, ("b", 2): 0, ("b", 3): 6}
    total = J.densify(df.drop("s"), cal, "day", fill=["n"])
    assert sorted((r.day.day, r.n) for r in total.collect()) == [(1, 5), (2, 0), (3, 6)]


def test_every_check_fails_on_broken_rows(spark):
    two = spark.createDataFrame([(1, "a"), (1, None)], "k int, v string")
    assert checks.check_unique(two, ["k"]).first().n == 2
    assert checks.check_not_null(two, ["k", "v"]).count() == 1
    assert checks.check_accepted(two, "v", ["b"]).count() == 1
    assert checks.check_accepted(two, "v", ["b"], F.col("k") > 1).count() == 0
    parent = spark.createDataFrame([(2,)], "id int")
    assert checks.check_relationship(two, "k", parent, "id").first().n == 2
    rates = spark.createDataFrame([(1.2, True, 1), (0.2, True, 2), (1.0, True, 3)],
                                  "item_fill_rate double, is_clean_order boolean, d int")
    assert checks.check_range(rates, "item_fill_rate", 0, 1).count() == 1
    assert [r.d for r in checks.check_fill_order(rates, ["d"]).collect()] == [2]
    flags = spark.createDataFrame([(False,), (False,)], "f boolean")
    assert checks.check_any(flags, "f").count() == 1
    assert checks.check_any(spark.createDataFrame([(True,)], "f boolean"), "f").count() == 0
    seen = spark.createDataFrame(
        [(D(2026, 3, 31), False), (D(2026, 3, 1), True), (D(2026, 3, 2), True)],
        "d date, f boolean")
    assert [r.d for r in checks.check_not_censored(seen, "d", "f", 30).collect()] == [
        D(2026, 3, 2)]
    assert checks.check_version_found(two, "v").count() == 1


def counts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "customer_id int, n long")


def test_outlier_bar_is_strict_and_survives_a_zero_mad(spark):
    tied = outliers.mad_outliers(counts(spark, [2, 2, 2, 50]), "customer_id", "n", 2.0)
    assert {r.is_outlier for r in tied.collect()} == {None}
    # median 3, MAD 1: with k = 1 / 1.4826 the bar is 4.
    k = 1 / 1.4826
    got = outliers.mad_outliers(counts(spark, [1, 2, 3, 4, 5]), "customer_id", "n", k)
    assert sorted(r.n for r in got.collect() if r.is_outlier) in ([5], [4, 5])
    row = outliers.robust_stats(counts(spark, [1, 2, 3, 9]), "n").first()
    assert (row.med, row.mad) == (2.5, 1.0)
    rough = outliers.robust_stats(counts(spark, [1, 2, 3, 4, 9]), "n", exact=False).first()
    assert (rough.med, rough.mad) == (3.0, 1.0)


def test_activity_counts_days_once(spark):
    df = spark.createDataFrame([(1, D(2026, 1, 1)), (1, D(2026, 1, 1)), (1, D(2026, 1, 2))],
                               "c int, d date")
    row = outliers.entity_activity(df, "c", "d").first()
    assert (row.order_count, row.active_days, row.orders_per_active_day) == (3, 2, 1.5)


def test_flag_scoring_and_sweep(spark):
    pred = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None)],
                                 "c int, p boolean")
    truth = spark.createDataFrame([(1, True), (3, True), (5, True)], "c int, t boolean")
    row = scoring.score_flag(pred, truth, "c", "p", "t").first()
    assert (row.true_positive, row.false_positive, row.false_negative, row.true_negative) == (
        1, 1, 2, 1)
    activity = counts(spark, [1, 2, 3, 4, 40])
    truth = spark.createDataFrame([(4, True)], "customer_id int, t boolean")
    swept = {r.k: r for r in outliers.sweep_threshold(
        activity, [0.1, 5, 100], truth, "customer_id", "n", "t").collect()}
    assert (swept[0.1].flagged, swept[0.1].precision, swept[0.1].recall) == (2, 0.5, 1.0)
    assert (swept[5.0].flagged, swept[5.0].precision) == (1, 1.0)
    assert (swept[100.0].flagged, swept[100.0].precision, swept[100.0].recall) == (0, None, 0.0)


def test_truth_comparisons(spark):
    est = spark.createDataFrame([("new", -8.1, -8.9, -7.3), ("old", -2.9, -3.8, -2.0)],
                                "g string, effect_pp double, ci_lo double, ci_hi double")
    near = spark.createDataFrame([("new", -12.5), ("old", -9.0)], "g string, v double")
    got = {r.g: r.within_tolerance for r in
           scoring.within_tolerance(est, near, "g", "v").collect()}
    assert got == {"new": True, "old": False}
    assert all(r.order_recovered is False for r in
               scoring.rank_matches(est, spark.createDataFrame(
                   [("new", 2.0), ("old", 1.0)], "g string, v double"),
                   "g", "effect_pp", "v").collect())
    assert [r.covers for r in scoring.covers(est, -3.0).collect()] == [False, True]
    clean = spark.createDataFrame([(False,)], "srm_detected boolean")
    found = spark.createDataFrame([(True,)], "srm_detected boolean")
    assert scoring.srm_consistency(clean, found).first().srm_consistent
    card = {r.check: r.passed for r in scoring.scorecard(
        ("a", found, "srm_detected"), ("b", clean, "srm_detected")).collect()}
    assert card == {"a": True, "b": False, "overall": False}


def test_event_log_profiles(spark):
    t = dt.datetime(2026, 1, 1, 20, 0)
    df = spark.createDataFrame([(1, t), (1, t), (2, t - dt.timedelta(hours=1))],
                               "k int, t timestamp_ntz")
    row = metrics.duplicate_share(df, ["k"]).first()
    assert (row.n_rows, row.n_keys) == (3, 2)
    assert metrics.day_shift_share(df, "t", "Asia/Dubai").first().n_moved == 2


def test_customer_orders_move_twice(spark):
    """From the window by customer to the facts by order, with the customer joined first."""
    import os

    from orderlens.registry.queries import context

    c = context(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from orderlens.plans import marts

        w = c.stored
        df = marts.fct_customer_orders(
            w["int_customer_order_sequence"], w["stg_orders"], w["fct_orders"], w["dim_customer"],
            w.params)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # The sequence by customer and by order, the facts by order, the customers.
    assert plan.count("Exchange hashpartitioning") == 4
