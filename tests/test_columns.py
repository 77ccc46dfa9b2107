import datetime as dt

from pyspark.sql import functions as F

from orderlens.functions import columns as C
from orderlens.params import SWAP_SEVERITY


def one(spark, **cols):
    """One row; timestamps become timestamps without zone."""
    df = spark.range(1).select(
        *[F.lit(str(v)).cast("timestamp_ntz").alias(k) if isinstance(v, dt.datetime)
          else F.lit(v).alias(k) for k, v in cols.items()]
    )
    return df


def at(text):
    return dt.datetime.fromisoformat(text)


def value(df, col):
    return df.select(col.alias("v")).first().v


def test_local_date_flips_at_the_zone_border(spark):
    late = one(spark, t=at("2026-01-04 20:00:00"))
    early = one(spark, t=at("2026-01-04 19:59:59"))
    assert value(late, C.local_date(F.col("t"), "Asia/Dubai")) == dt.date(2026, 1, 5)
    assert value(early, C.local_date(F.col("t"), "Asia/Dubai")) == dt.date(2026, 1, 4)
    assert value(late, C.local_hour(F.col("t"), "Asia/Dubai")) == 0


def test_local_clock_in_a_zone_with_daylight_saving(spark):
    winter = one(spark, t=at("2026-01-10 12:00:00"))
    summer = one(spark, t=at("2026-07-10 12:00:00"))
    assert value(winter, C.local_hour(F.col("t"), "Europe/Berlin")) == 13
    assert value(summer, C.local_hour(F.col("t"), "Europe/Berlin")) == 14


def test_results_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = one(spark, a=at("2026-03-08 01:59:30"), b=at("2026-03-08 03:00:10"))
        assert value(df, C.minutes_between(F.col("a"), F.col("b"))) == 61
        assert value(df, C.local_hour(F.col("a"), "Asia/Dubai")) == 5
        assert value(df, C.days_between(F.col("a"), F.col("b"))) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_minutes_and_days_count_borders(spark):
    df = one(spark, a=at("2026-01-01 00:00:59"), b=at("2026-01-01 00:01:00"))
    assert value(df, C.minutes_between(F.col("a"), F.col("b"))) == 1
    night = one(spark, a=at("2026-01-01 23:59:00"), b=at("2026-01-02 00:01:00"))
    assert value(night, C.days_between(F.col("a"), F.col("b"))) == 1


def test_late_is_strictly_above_the_threshold(spark):
    start = at("2026-01-01 10:00:30")
    flags = []
    for minutes in (59, 60, 61):
        df = one(spark, e=start, i=start + dt.timedelta(minutes=minutes))
        row = C.with_ingest_lag(df, "e", "i", 60).first()
        flags.append((row.ingestion_lag_minutes, row.is_late_arriving))
    assert flags == [(59, False), (60, False), (61, True)]


def test_null_bucket_keeps_rows_and_flags_them(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    got = {(r.c, r.f) for r in C.bucket_nulls(df, "c", "Unmapped", "f").collect()}
    assert got == {("a", False), ("Unmapped", True)}


def test_set_flag_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert [r[0] for r in df.select(C.in_set_flag(F.col("c"), ["a"])).collect()] == [
        True, False, None]


def test_ratio_by_zero_is_null(spark):
    assert value(one(spark, a=1, b=0), C.safe_ratio(F.col("a"), F.col("b"))) is None


def test_bands_include_their_upper_edge(spark):
    df = spark.createDataFrame([(i,) for i in (1, 3, 4, 6, 7, 10, 11, 15, 16)], "n int")
    edges, labels = (3, 6, 10, 15), ("1-3", "4-6", "7-10", "11-15", "16+")
    got = [r[0] for r in df.orderBy("n").select(C.band(F.col("n"), edges, labels)).collect()]
    assert got == ["1-3", "1-3", "4-6", "4-6", "7-10", "7-10", "11-15", "11-15", "16+"]


def test_rank_codes_round_trip(spark):
    df = spark.createDataFrame([(s,) for s in (*SWAP_SEVERITY, None, "other")], "s string")
    coded = df.withColumn("r", C.encode_rank(F.col("s"), SWAP_SEVERITY))
    back = coded.withColumn("b", C.decode_rank(F.col("r"), SWAP_SEVERITY))
    got = {(r.s, r.r, r.b) for r in back.collect()}
    assert got == {(s, i + 1, s) for i, s in enumerate(SWAP_SEVERITY)} | {
        (None, None, None), ("other", None, None)}


def test_offer_arms_treat_unknown_as_not(spark):
    df = spark.createDataFrame(
        [(True, True), (True, False), (True, None), (False, None), (None, None)],
        "substitute_offered boolean, substitute_accepted boolean",
    )
    got = [r.offer_arm for r in C.split_offer(df).collect()]
    assert got == ["accepted", "declined", "declined", "not_offered", "not_offered"]


def test_fill_identity_and_its_inverse(spark):
    df = one(spark, p=0.05, n=8)
    fill = value(df, C.order_fill_identity(F.col("p"), F.col("n")))
    assert abs(fill - 0.95**8) < 1e-12
    back = value(df.withColumn("t", F.lit(fill)), C.required_miss(F.col("t"), F.col("n")))
    assert abs(back - 0.05) < 1e-12


def test_two_significant_digits(spark):
    df = spark.createDataFrame([(675704.0,), (141.2,), (0.0,), (-98.6,)], "x double")
    got = [r[0] for r in df.select(C.round_significant(F.col("x"))).collect()]
    assert got == [680000.0, 140.0, 0.0, -99.0]


def test_surrogate_key_tells_versions_apart(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2026, 1, 1)), (1, dt.date(2026, 2, 1))], "id int, d date")
    keys = [r[0] for r in df.select(C.surrogate_key(F.col("id"), F.col("d"))).collect()]
    assert len(set(keys)) == 2
