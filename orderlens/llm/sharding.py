"""Proportional stratified interleaving: rows dealt to shards that all match the mixture.

Rows are shuffled within their source by a seeded digest. Row r of a source with n rows has
the fractional rank (r + 1/2) / n. All rows in the order of their fractional ranks, ties by
source, are one sequence in which every source is spread evenly; it is cut into shards whose
counts of rows are at most one apart, so each holds its share of every source to within about
one row a source. The law is ``rows``.

Both rankings are distributed. The digest deals the rows of a source to buckets of equal
expected size, and the fractional rank deals all rows to cells that cannot be uneven: a cell
spans the same part of every source. Ranks are counted inside a bucket or cell and moved on
by the counts of those before it, which is one small row for each. Repeated rows are counted
before they travel; copies of one row beyond BLOCK get digests of their own, so they spread
like other rows. Texts never travel: sizes and digests are taken where a text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import CRC_TABLE, crc32_sql, stored, tasks

SEED = 11
SHARDS = 24
BLOCK = 4096  # copies of one row that share a digest
CELL = 1 << 20  # rows ranked together


def _identity(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """What tells rows apart, and what is reported of them; a null text counts as empty."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        (F.octet_length(body) + 8).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.sha2(body, 256).alias("text_sha256"),
    )


def _stratum() -> Column:
    """The source as a key that is never null, so joins and windows share an exchange."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = SEED,
    cell_rows: int = CELL,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, source, size, text_crc32, text_sha256, shard, slot) of every row.

    ``size`` is the text's UTF-8 bytes plus 8; slots count from 0 without gaps in each
    shard. A null text counts as empty and a null source is a source of its own. Repeated
    rows come back as often as they are, in places of their own. With fewer rows than
    shards some shards stay empty; an empty table gives no rows. Other columns are not
    looked at. ``cell_rows`` changes how the work is split, never the result.
    """
    rows = _identity(docs, key, text, source)
    base = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "identities")
    total = base.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    cells = max(tasks(docs.sparkSession), -(-total // cell_rows))  # a hot source fills all tasks

    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), "text_sha256", "block"))
    shuffled = (
        base.withColumn("block", F.explode(F.expr(f"sequence(0L, copies - 1, {block}L)")))
        .withColumn("weight", F.least(F.lit(block), F.col("copies") - F.col("block")))
        .withColumn("block", F.expr(f"block div {block}"))
        .withColumns({"stratum": _stratum(), "digest": digest})
        .withColumn("bucket", F.expr(f"cast(conv(left(digest, 8), 16, 10) as bigint) * {cells} >> 32"))
    )
    along = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = shuffled.groupBy("stratum", "bucket").agg(F.sum("weight").alias("inside"))
    buckets = buckets.select(
        "stratum",
        "bucket",
        F.coalesce(F.sum("inside").over(along), F.lit(0)).alias("earlier"),
        F.sum("inside").over(Window.partitionBy("stratum")).alias("n"),
    )
    within = Window.partitionBy("stratum", "bucket").orderBy("digest", "doc_id")
    before = F.coalesce(F.sum("weight").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = (
        shuffled.withColumn("before", before)
        .join(buckets, ["stratum", "bucket"])
        .withColumn("copy", F.explode(F.expr("sequence(0L, weight - 1)")))
        .withColumn("odd", 2 * (F.col("earlier") + F.col("before") + F.col("copy")) + 1)
        .withColumn("cell", F.floor(F.col("odd") / (2 * F.col("n")) * cells))
        .select(*rows.columns, "stratum", "odd", "n", "cell")
    )
    ranked = stored(ranked, "ranked")

    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("cell").agg(F.count("*").alias("inside"))  # one row for CELL rows
    counts = counts.select("cell", F.coalesce(F.sum("inside").over(order), F.lit(0)).alias("start"))
    fraction = F.col("odd") / (2 * F.col("n"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy(fraction, "stratum", "odd"))
    return (
        ranked.withColumn("place", place)
        .join(counts, "cell")
        .withColumn("position", F.col("start") + F.col("place") - 1)
        .withColumn("shard", F.expr(f"position * {shards} div {max(1, total)}"))
        .withColumn("slot", F.expr(f"position - (shard * {total} + {shards - 1}) div {shards}"))
        .select(*rows.columns, F.col("shard").cast("int").alias("shard"), "slot")
    )


def write(docs: DataFrame, assigned: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> None:
    """The texts as Parquet below ``path``, a folder for each shard, files in slot order.

    A text travels once, with its key and digest; repeated rows are written from one copy.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(
        F.concat_ws(":", F.sha2(body, 256), F.col(key).cast("string")).alias("name"), body.alias("text")
    ).dropDuplicates(["name"])
    named = assigned.withColumn("name", F.concat_ws(":", "text_sha256", F.col("doc_id").cast("string")))
    placed = named.join(texts, "name").select("shard", "slot", "doc_id", "source", "text")
    laid_out = placed.hint("rebalance", F.col("shard")).sortWithinPartitions("shard", "slot")
    laid_out.write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of every document; the mixture comes from ``source``."""
    return assign(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "text_sha256",
    )


ORACLE = f"""
WITH {CRC_TABLE},
identified AS (
  SELECT doc_id, source, strlen(body) + 8 AS size, sha256(body) AS text_sha256,
         {crc32_sql("body")} AS text_crc32
  FROM (SELECT doc_id, source, coalesce(text, '') AS body FROM documents), crc_table
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, text_sha256) - 1 AS copy FROM identified
),
ranked AS (
  SELECT *,
         row_number() OVER (
           PARTITION BY source
           ORDER BY md5(concat_ws(':', '{SEED}', doc_id, text_sha256, copy // {BLOCK})), doc_id, copy
         ) - 1 AS r,
         count(*) OVER (PARTITION BY source) AS n
  FROM numbered
),
placed AS (
  SELECT *, count(*) OVER () AS total,
         row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n), source NULLS FIRST, r) - 1 AS position
  FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * {SHARDS} // total)::INT AS shard,
       position - (position * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} AS slot,
       NULL::INT AS grown_shard, source, text_sha256
FROM placed
"""
