"""Scalar expressions: time, ranges, labels, ratios. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.params import OPEN_END


# --- time ------------------------------------------------------------------
def clock_minutes(ts: Column) -> Column:
    """Whole minutes since 1970 on the column's own clock.

    Read from the calendar fields: no session zone is involved.
    """
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days * 1440 + F.hour(ts) * 60 + F.minute(ts)


def utc_wall_clock(text: Column) -> Column:
    """Text of an instant -> UTC clock without zone.

    An offset or Z is honoured; text without one already is UTC. The instant goes
    through its count of microseconds, so the session zone plays no part.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = F.timestamp_add("MICROSECOND", F.unix_micros(text.cast("timestamp")), epoch)
    has_zone = text.rlike("(Z|[+-][0-9]{2}(:?[0-9]{2})?)$") & text.contains(":")
    return F.when(has_zone, instant).otherwise(text.cast("timestamp_ntz"))


def to_local(ts: Column, tz: str) -> Column:
    """UTC wall clock -> reporting wall clock, both without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def local_date(ts: Column, tz: str) -> Column:
    return to_local(ts, tz).cast("date")


def local_hour(ts: Column, tz: str) -> Column:
    return F.hour(to_local(ts, tz)).cast("bigint")


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed from start to end (00:00:59 -> 00:01:00 is 1)."""
    return clock_minutes(end) - clock_minutes(start)


def days_between(start: Column, end: Column) -> Column:
    """Date boundaries crossed from start to end (23:59 -> 00:01 is 1)."""
    return F.datediff(end, start).cast("bigint")


def with_ingest_lag(df: DataFrame, event: str, ingest: str, threshold: int = 60) -> DataFrame:
    """Lag between event and ingestion; late is strictly above the threshold."""
    lag = minutes_between(F.col(event), F.col(ingest))
    return df.withColumns(
        {"ingestion_lag_minutes": lag, "is_late_arriving": lag > threshold}
    )


# --- dimensions ------------------------------------------------------------
def bucket_nulls(df: DataFrame, col: str, label: str, flag: str) -> DataFrame:
    """Give missing values a visible bucket and a flag; no row is filtered."""
    return df.withColumns(
        {flag: F.col(col).isNull(), col: F.coalesce(F.col(col), F.lit(label))}
    )


def close_open_range(valid_to: Column) -> Column:
    return F.coalesce(valid_to.cast("date"), F.lit(OPEN_END).cast("date"))


def surrogate_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


# --- ratios and flags ------------------------------------------------------
def joined_flag(right_key: Column) -> Column:
    return right_key.isNotNull()


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL where den is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def line_value(quantity: Column, price: Column) -> Column:
    return quantity * price


def in_set_flag(col: Column, values: Sequence[str]) -> Column:
    """Membership flag; NULL stays NULL."""
    return col.isin(*values)


def outcome_bool(col: Column) -> Column:
    """A missing outcome is a negative one. Apply after the censoring filter."""
    return F.coalesce(col, F.lit(False))


def share(condition: Column) -> Column:
    """Aggregate: share of rows where the condition holds."""
    return safe_ratio(F.count_if(condition), F.count(F.lit(1)))


# --- labels ----------------------------------------------------------------
def band_index(col: Column, edges: Sequence[float]) -> Column:
    """1-based band of a value; edges are inclusive upper bounds."""
    out = F.lit(1)
    for edge in edges:
        out = out + (col > edge).cast("int")
    return out


def band(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Band label of a value; labels has one entry more than edges."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), band_index(col, edges))


def encode_rank(col: Column, ordered: Sequence[str]) -> Column:
    """Position (from 1) of a value in an ordered list, NULL when absent."""
    position = F.array_position(F.array(*[F.lit(v) for v in ordered]), col)
    return F.nullif(position.cast("int"), F.lit(0))


def decode_rank(rank: Column, ordered: Sequence[str]) -> Column:
    """Inverse of encode_rank."""
    return F.get(F.array(*[F.lit(v) for v in ordered]), rank - 1)


def tenure(prior: Column, max_prior: int) -> Column:
    return F.when(prior <= max_prior, "new").otherwise("established")


def offer_arm(offered: Column, accepted: Column) -> Column:
    """accepted / declined / not_offered; unknown counts as not so."""
    return (
        F.when(F.coalesce(accepted, F.lit(False)), "accepted")
        .when(F.coalesce(offered, F.lit(False)), "declined")
        .otherwise("not_offered")
    )


def split_offer(df: DataFrame) -> DataFrame:
    arm = offer_arm(F.col("substitute_offered"), F.col("substitute_accepted"))
    return df.withColumn("offer_arm", arm)


# --- fill identity ---------------------------------------------------------
def order_fill_identity(miss: Column, n: Column) -> Column:
    """Chance that all n items of a basket are there at a given item miss rate."""
    return F.pow(1 - miss, n)


def required_miss(target: Column, n: Column) -> Column:
    """Item miss rate at which a basket of n items meets an order fill target."""
    return 1 - F.pow(target, 1 / n)


def round_significant(x: Column, digits: int = 2) -> Column:
    """Round to significant digits; zero stays zero."""
    unit = F.pow(F.lit(10.0), F.ceil(F.log10(F.abs(F.nullif(x, F.lit(0.0))))) - digits)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / unit) * unit)
