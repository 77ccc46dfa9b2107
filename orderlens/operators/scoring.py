"""Scoring of estimates and flags against a truth that is passed in separately."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.columns import safe_ratio
from orderlens.operators.ranks import before
from orderlens.session import keep


def score_flag(pred: DataFrame, truth: DataFrame, key: str, flag: str, label: str) -> DataFrame:
    """Confusion counts, precision and recall; a key missing on a side counts as false."""
    both = pred.select(key, flag).join(truth.select(key, label), key, "full")
    p, t = (F.coalesce(F.col(c), F.lit(False)) for c in (flag, label))
    counts = both.agg(
        F.count_if(p & t).alias("true_positive"),
        F.count_if(p & ~t).alias("false_positive"),
        F.count_if(~p & t).alias("false_negative"),
        F.count_if(~p & ~t).alias("true_negative"),
    )
    hit = F.col("true_positive")
    return counts.withColumns(
        {
            "precision": safe_ratio(hit, hit + F.col("false_positive")),
            "recall": safe_ratio(hit, hit + F.col("false_negative")),
        }
    )


def within_tolerance(
    estimates: DataFrame, truth: DataFrame, key: str, value: str, pad: float = 4.0
) -> DataFrame:
    """Whether the true value lies within the padded interval of its estimate."""
    joined = estimates.select(key, "effect_pp", "ci_lo", "ci_hi").join(
        truth.select(key, value), key
    )
    near = F.col(value).between(F.col("ci_lo") - pad, F.col("ci_hi") + pad)
    return joined.withColumn("within_tolerance", near)


def rank_matches(
    estimates: DataFrame,
    truth: DataFrame,
    key: str,
    estimate: str,
    value: str,
    cell_rows: int | None = None,
) -> DataFrame:
    """Whether groups ordered by estimate come in the order of the true values.

    Ties go to the smaller key. A few groups are ranked as one sorted array; with
    ``cell_rows`` there may be any number, ranked over cells of a range partition.
    """
    joined = estimates.select(key, estimate).join(truth.select(key, value), key)
    if cell_rows is None:
        ranked = joined
        for column, out in ((estimate, "estimated_rank"), (value, "true_rank")):
            ranked = _few_ranked(ranked, key, column, out)
    else:
        ranked = joined
        for column, out in ((estimate, "estimated_rank"), (value, "true_rank")):
            order = [F.col(column).desc(), F.col(key).asc()]
            ranked = before(ranked, order, out, cell_rows=cell_rows)
            ranked = ranked.withColumn(out, (F.col(out) + 1).cast("int"))
        ranked = keep(ranked)
    same = ranked.agg(F.bool_and(F.col("estimated_rank") == F.col("true_rank"))).scalar()
    return ranked.withColumn("order_recovered", same)


def _few_ranked(df: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """The place of each row in the falling order of a column, through one array of all."""
    v = F.col(column)
    row = F.struct(*df.columns).alias("_row")
    rows = F.sort_array(F.collect_list(F.struct(v.isNull(), (-v).alias("_v"), F.col(key).alias("_k"), row)))
    placed = df.agg(rows.alias("_rows")).select(F.posexplode("_rows"))
    return placed.select("col._row.*", (F.col("pos") + 1).alias(out))


def covers(df: DataFrame, value: float, lo: str = "ci_lo", hi: str = "ci_hi") -> DataFrame:
    """Whether an interval contains a given value."""
    return df.withColumn("covers", F.lit(float(value)).between(F.col(lo), F.col(hi)))


def srm_consistency(assigned: DataFrame, exposed: DataFrame) -> DataFrame:
    """One row: clean split at assignment, detected mismatch at exposure."""
    tagged = assigned.select(F.lit("a").alias("at"), "srm_detected").unionByName(
        exposed.select(F.lit("e").alias("at"), "srm_detected")
    )

    def seen(at: str) -> Column:
        return F.bool_or(F.when(F.col("at") == at, F.col("srm_detected")))

    return tagged.agg(
        seen("a").alias("detected_at_assignment"), seen("e").alias("detected_at_exposure")
    ).withColumn(
        "srm_consistent", ~F.col("detected_at_assignment") & F.col("detected_at_exposure")
    )


def scorecard(*checks: tuple[str, DataFrame, str]) -> DataFrame:
    """(name, rows, boolean column) -> one row per check plus the overall verdict."""
    rows = None
    for name, df, column in checks:
        one = df.agg(F.bool_and(F.coalesce(column, F.lit(False))).alias("passed")).select(
            F.lit(name).alias("check"), "passed"
        )
        rows = one if rows is None else rows.unionByName(one)
    overall = rows.agg(F.bool_and("passed").alias("passed")).select(
        F.lit("overall").alias("check"), "passed"
    )
    return rows.unionByName(overall)
