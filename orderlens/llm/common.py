"""Reading the tables, keeping intermediate tables, and streaming groups through Arrow."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.session import work_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own below the cluster's shared checkpoint folder."""
    return f"{work_dir(spark)}/orderlens-llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once in the shared folder, read back: cuts the lineage for what follows."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def tasks(spark: SparkSession) -> int:
    """How many tasks a shuffle is dealt to; the cluster's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut to at most ``rows`` rows, so that working memory stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a string column has about ``most`` bytes in each, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        share = (np.cumsum(lengths.astype(np.int64)) - lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if start < end:
                yield batch.slice(start, end - start)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table per run of equal keys; the input is sorted by ``key`` within the task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held:
            last = held[-1]
            before = last.column(last.schema.get_field_index(key))[last.num_rows - 1].as_py()
            if before != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
        for start, end in zip(cuts[:-2], cuts[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
            held = []
        held.append(batch.slice(cuts[-2], cuts[-1] - cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


# CRC-32 in DuckDB: a table of 256 remainders from the reflected polynomial, then byte by byte.
CRC_TABLE = """
remainders AS (
  SELECT i, list_reduce(
    range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i
  ) AS remainder
  FROM range(256) numbers(i)
),
crc_table AS (SELECT list(remainder ORDER BY i) AS crcs FROM remainders)"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, in a query that reads ``crc_table``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = "lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])"
    return f"xor(4294967295, list_reduce({octets}, {step}, 4294967295::BIGINT))"
