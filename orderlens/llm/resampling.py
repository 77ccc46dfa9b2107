"""Importance resampling of documents towards a target, over hashed word features.

Features are words and pairs of consecutive words; CRC-32 deals them to buckets. How often
each bucket occurs in all documents and in all target texts gives its gain, the logarithm of
the smoothed ratio; a document's weight is the mean gain of its features. Weights plus seeded
Gumbel noise are ranked, and the highest are drawn: a sample without replacement, in proportion
to the exponential of the weight.

CRCs are taken for many features at once. The distinct features of a batch are grouped by
length, so that each group is a matrix of bytes with a row per feature; the CRCs of all its
rows are updated column by column through one table of 256 remainders, and the buckets are
scattered back to the places where the features occur.

Each text is read once; what stays is one short integer per feature. Counts are sums of
fixed-size tables, the drawing threshold comes from a count per score, and only documents at
or above it are ranked, over cells of a range partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import CRC_TABLE, crc32_sql, sized, stored
from orderlens.operators.ranks import before

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25  # percent of the documents with enough words
SEED = 7
BATCH = 1 << 20  # bytes of text hashed at once
LONG = 512  # features beyond this length are too rare for a matrix of their own
BLOCK = 4096  # copies of one row that are ranked as one

POLYNOMIAL = 0xEDB88320


def _remainders() -> np.ndarray:
    """The CRC-32 of each byte, from the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(POLYNOMIAL) ^ (table >> 1), table >> 1)
    return table


REMAINDERS = _remainders()
IN_WORD = np.zeros(256, bool)  # bytes of words once A-Z is lower-cased
for _first, _last in (b"09", b"az", b"\x80\xff"):
    IN_WORD[_first : _last + 1] = True


def crcs(features: pa.Array) -> np.ndarray:
    """The CRC-32 of each value of a binary array, by one byte matrix for each length."""
    edges, data = _buffers(features)
    lengths = np.diff(edges)
    out = np.zeros(len(features), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        length = int(lengths[rows[0]])
        if length > LONG:
            for i in rows.tolist():
                out[i] = zlib.crc32(data[edges[i] : edges[i + 1]])
            continue
        matrix = data[edges[rows][:, None] + np.arange(length)]
        held = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            held = REMAINDERS[(held ^ column) & 0xFF] ^ (held >> 8)
        out[rows] = held ^ np.uint32(0xFFFFFFFF)
    return out


def _buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Edges and bytes of a large binary or string array without nulls."""
    _, edges, data = array.buffers()
    places = np.frombuffer(edges, np.int64)[array.offset : array.offset + len(array) + 1]
    return places, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _binary(edges: np.ndarray, data: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, buffers)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, one after the other, and the edges of the texts among them."""
    edges, data = _buffers(pc.fill_null(texts, "").cast(pa.large_string()))
    first = edges[0]
    data = data[first : edges[-1]]
    edges = edges - first
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = IN_WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = edges[:-1][edges[:-1] < len(data)]
    starts[begins] = inside[begins]
    starts = np.flatnonzero(starts)
    kept = np.concatenate([[0], np.cumsum(inside)])
    cuts = np.append(kept[starts], kept[-1])
    return _binary(cuts, data[inside]), np.searchsorted(starts, edges)


def buckets(texts: pa.Array, count: int = BUCKETS, joined: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature, text by text, and the edges of the texts among them.

    ``joined`` leaves out each text's first word, which a stretch before it has counted.
    """
    own, edges = words(texts)
    n = len(own)
    if not n:
        return np.zeros(0, np.int16), np.zeros(len(edges), np.int64)
    last = np.zeros(n, bool)
    ends = edges[1:][edges[1:] > edges[:-1]] - 1
    last[ends] = True
    left = np.flatnonzero(~last)
    at = pa.array(left)
    pairs = pc.binary_join_element_wise(own.take(at), own.take(pc.add(at, 1)), pa.scalar(b" ", pa.large_binary()))
    spots = pa.concat_arrays([own, pairs]).dictionary_encode()
    bucket = (crcs(spots.dictionary) % count).astype(np.int16)[spots.indices.to_numpy()]
    single = np.ones(n, bool)
    if joined:
        single[edges[:-1][edges[1:] > edges[:-1]]] = False
    # Each word is followed by the pair that it begins.
    many = np.cumsum(single.astype(np.int64) + ~last)
    after = np.concatenate([[0], many])
    out = np.empty(after[-1], np.int16)
    out[after[:-1][single]] = bucket[:n][single]
    out[after[1:][left] - 1] = bucket[n:]
    return out, after[edges]


def stretches(text: str, most: int) -> Iterator[bytes]:
    """A text's UTF-8 bytes in parts that end before a byte outside words; the next part
    starts with the last word again, so that every pair lies in one part."""
    data = text.encode("utf-8", "surrogatepass")
    start, fresh = 0, 0
    while fresh < len(data):
        end = min(len(data), fresh + most)
        while end < len(data) and _word_byte(data[end]):
            end += 1
        part = data[start:end]
        if fresh and not any(map(_word_byte, data[fresh:end])):
            fresh = end  # nothing new: the word before waits for the next part
            continue
        yield part
        stop = end
        while stop > start and not _word_byte(data[stop - 1]):
            stop -= 1
        back = stop
        while back > start and _word_byte(data[back - 1]):
            back -= 1
        start, fresh = (back, end) if stop > start else (end, end)


def _word_byte(byte: int) -> bool:
    return bool(IN_WORD[byte]) or 65 <= byte <= 90


def long_buckets(text: str, most: int, count: int = BUCKETS) -> np.ndarray:
    """The buckets of one text that is too long to be hashed at once."""
    parts = []
    carried = False
    for part in stretches(text, most):
        got, _ = buckets(pa.array([part.decode("utf-8", "surrogatepass")], pa.large_string()), count, carried)
        parts.append(got)
        carried = carried or bool(len(got))
    return np.concatenate(parts) if parts else np.zeros(0, np.int16)


def featured(table: DataFrame, key: str, text: str, count: int = BUCKETS, most: int = BATCH) -> DataFrame:
    """(key, buckets): the bucket of every feature of every text; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 1, most):
            body = batch.column(1)
            if batch.num_rows == 1 and (pc.binary_length(body)[0].as_py() or 0) > 2 * most:
                values = long_buckets(body[0].as_py(), most, count)
                edges = np.array([0, len(values)])
            else:
                values, edges = buckets(body, count)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "buckets"])

    plain = table.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(run, f"key {kind}, buckets array<smallint>")


def bucket_counts(features: DataFrame, count: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features; a task sends one table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(count, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=count)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(held[found])], ["bucket", "n"])

    sums = features.select("buckets").mapInArrow(run, "bucket int, n bigint")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, count: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln) of its smoothed share in the target over that in the source."""
    s, t = (bucket_counts(f, count).withColumnRenamed("n", n) for f, n in ((source, "s"), (target, "t")))
    every = source.sparkSession.range(count).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"]).orderBy("bucket")
    rows = both.select(F.col("s").cast("double"), F.col("t").cast("double")).collect()
    s, t = np.array(rows, np.float64).T
    ratio = (t + 1) * (s.sum() + count) / ((s + 1) * (t.sum() + count))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(key, n_features, n_words, weight): the floored mean gain, 0 for no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            many = lists.value_lengths().to_numpy().astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(gains[lists.flatten().to_numpy()])])
            ends = np.cumsum(many)
            weight = (sums[ends] - sums[ends - many]) // np.maximum(many, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(many), pa.array((many + 1) // 2), pa.array(weight)],
                ["key", "n_features", "n_words", "weight"],
            )

    kind = features.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_features bigint, n_words bigint, weight bigint"
    return features.select("key", "buckets").mapInArrow(run, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every document; rank null if it is not drawn.

    Drawn are floor(share * N / 100) of the N documents with at least ``least_words`` words,
    the highest scores first, ties to the smaller key, a null key before others. A null or
    empty text has no features, weight 0 and the score of its noise, and is never drawn by
    default. Repeated rows count as often as they come, have equal scores and follow each other
    in rank. The noise depends on seed and key only; a null key counts as empty text. An empty
    target gives gains by smoothing alone; an empty table gives no rows. Other columns are not
    looked at.
    """
    own = stored(featured(docs, key, text), "features")
    wanted = target.withColumn("_nothing", F.lit(0))
    gains = bucket_gains(own, stored(featured(wanted, "_nothing", target_text), "target-features"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    uniform = (F.conv(F.left(F.sha2(name, 256), F.lit(8)), 16, 10).cast("bigint") + 0.5) / 4294967296.0
    scored = weighed(own, gains).withColumn(
        "score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))).cast("bigint")
    )
    scored = stored(scored, "scored")

    # Scores are whole numbers between fixed bounds, so this has few rows at any size.
    able = F.col("n_words") >= least_words
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    levels = levels.withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    total = levels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    drawn = share * total // 100
    least = levels.filter(F.col("above") < drawn).agg(F.min("score")).first()[0]
    columns = ["key", "n_features", "weight", "score"]
    high = able & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    others = scored.filter(~high).select(*columns, F.lit(None).cast("bigint").alias("rank"))

    copies = scored.filter(high).groupBy(*columns).agg(F.count("*").alias("copies"))
    blocks = copies.withColumn("block", F.explode(F.expr(f"sequence(0L, copies - 1, {BLOCK}L)")))
    blocks = blocks.withColumn("weight_of_block", F.least(F.lit(BLOCK), F.col("copies") - F.col("block")))
    order = [F.desc("score"), F.asc("key"), F.asc("n_features"), F.asc("weight"), F.asc("block")]
    placed = before(blocks, order, "earlier", weight="weight_of_block")
    each = placed.withColumn("copy", F.explode(F.expr("sequence(1L, weight_of_block)")))
    place = F.col("earlier") + F.col("copy")
    ranked = each.select(*columns, F.when(place <= drawn, place).alias("rank"))
    return ranked.unionByName(others).withColumnRenamed("key", key)


def drawn(docs: DataFrame, ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key was drawn; rows that share a key stay together."""
    keys = ranked.filter(F.col("rank").isNotNull()).select(F.col(key).alias("_drawn")).distinct()
    return docs.join(keys, F.col(key).eqNullSafe(F.col("_drawn")), "left_semi")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _features_sql(table: str, key: str) -> str:
    """(key, n_words, feature) rows of a table, in DuckDB."""
    return f"""
  SELECT {key} AS key, len(words) AS n_words, unnest(list_concat(
    words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
  )) AS feature
  FROM (
    SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                     '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words
    FROM {table}
  )"""


ORACLE = f"""
WITH {CRC_TABLE},
own AS ({_features_sql("documents", "doc_id")}),
wanted AS ({_features_sql("benchmark", "0")}),
dealt AS (
  SELECT feature, {crc32_sql("feature")} % {BUCKETS} AS bucket
  FROM (SELECT feature FROM own UNION SELECT feature FROM wanted), crc_table
),
counted AS (
  SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t
  FROM (
    SELECT feature, count(*) AS s, 0 AS t FROM own GROUP BY feature
    UNION ALL SELECT feature, 0, count(*) FROM wanted GROUP BY feature
  ) JOIN dealt USING (feature) GROUP BY bucket
),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((sum(s) OVER ()) + {BUCKETS})
    / ((s + 1) * ((sum(t) OVER ()) + {BUCKETS}))))::BIGINT AS gain
  FROM counted
),
summed AS (
  SELECT key AS doc_id, any_value(n_words) AS n_words, count(*) AS n, sum(gain)::BIGINT AS total
  FROM own JOIN dealt USING (feature) JOIN gains USING (bucket) GROUP BY key
),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(n_words, 0) AS n_words,
         coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT + 0.5)
           / 4294967296.0)))::BIGINT AS noise
  FROM documents LEFT JOIN summed USING (doc_id)
),
placed AS (
  SELECT doc_id, weight + noise AS score,
         row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS able
  FROM scored WHERE n_words >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, weight + noise AS score,
       CASE WHEN place <= {SHARE} * able // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
