"""From raw documents to packed training sequences, one operator per stage.

Each stage is written as Parquet and reread as the next one's documents. Toxic documents
go, repeated passages are cut, one document of each group of near copies stays, personal
data is masked, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import linededup, packing, pii, simhash, toxicity
from orderlens.llm.common import read, stored


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted anew where a stage rewrites texts."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_ordinary(docs, model)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(linededup.remove_repeats(docs, counts=False), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeats),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]

# Models, rolling hashes and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of the folder that the stages keep."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
