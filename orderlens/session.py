"""Session settings and the shared working folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are written for. A join whose key is hot is
# split by the adaptive planner, also where that costs one more exchange.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings; sizes and memory stay the cluster's."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir``, always set outside."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return shared.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Compute a small intermediate result once, in the shared checkpoint folder.

    For aggregates that several read-outs start from: without it each read-out
    would scan the facts again with its own columns.
    """
    context = df.sparkSession.sparkContext
    shared = work_dir(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return df.checkpoint()
