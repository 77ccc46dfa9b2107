"""Document fingerprints by randomised edit embedding.

A walk reads a text from the left: at every step it writes the character it stands on
and then goes on or stays, as a random bit that all texts share decides by step and
character. Two texts with few edits fall into step again soon after each, so their
edit distance becomes a Hamming distance of what the walks wrote. The fingerprint
samples the written sequence at fixed steps, SAMPLES from each doubling of the length,
and keeps four bits of each; a longer text has more samples, none is cut. The likeness
of two fingerprints is the share of equal samples, each weighted by the steps it stands
for. Samples taken together as bands find candidates; an exact edit distance verifies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import sized, stored, tasks, texts
from orderlens.llm.components import components

SEED = 11
SAMPLES = 64  # per doubling of the walk's length
PERIOD = 1 << 14  # steps after which the random bits repeat
STOP = 255  # the class of the place behind a text
STRETCH = 8 << 20  # bytes of text whose walks go in step
BANDS, ROWS = 16, 4  # bands per doubling, samples per band


@lru_cache(maxsize=1)
def _shared() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    bits = draw.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
    bits[:, STOP] = 0
    symbol = draw.integers(0, 16, 256, dtype=np.uint8)
    symbol[STOP] = STOP
    return bits, symbol


@lru_cache(maxsize=64)
def _octave(k: int) -> np.ndarray:
    """Steps sampled between 2**k - 1 and 2**(k + 1) - 1."""
    size = 1 << k
    if size <= SAMPLES:
        return np.arange(size) + size - 1
    draw = np.random.default_rng([SEED, k])
    return np.sort(draw.choice(size, SAMPLES, replace=False)) + size - 1


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    return np.concatenate([np.full(len(_octave(k)), (1 << k) / len(_octave(k))) for k in range(28)])


def fingerprints(many: list[str]) -> list[str]:
    """The fingerprint of each text, all walks in step; empty for an empty text."""
    bits, symbol = _shared()
    coded, ends = [], []
    for text in many:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        mixed = (points.astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(13)
        coded += [(mixed % np.uint64(STOP)).astype(np.uint8), np.array([STOP], np.uint8)]
        ends.append(len(points) + 1)
    if not many:
        return []
    flat = np.concatenate(coded)
    place = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64)
    rows = np.arange(len(many))
    live = flat[place] != STOP
    place, rows = place[live], rows[live]
    taken: list[list[np.ndarray]] = []
    step, k = 0, 0
    wanted = _octave(0).tolist()
    while len(place):
        for target in wanted:
            while step < target:
                here = flat[place]
                if step & 255 == 0:
                    on = here != STOP
                    if not on.all():
                        place, rows, here = place[on], rows[on], here[on]
                place += bits[step % PERIOD][here]
                step += 1
            taken.append([rows, symbol[flat[place]]])
        on = flat[place] != STOP
        place, rows, k = place[on], rows[on], k + 1
        wanted = _octave(k).tolist()
    held = np.full((len(many), len(taken)), STOP, np.uint8)
    for column, (own, got) in enumerate(taken):
        held[own, column] = got
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    written = digits[np.minimum(held, 15)]
    counts = (held != STOP).sum(axis=1)
    return [row[:n].tobytes().decode() for row, n in zip(written, counts)]


def likeness(a: str, b: str) -> float:
    """Weighted share of equal samples, 0 to 1; 1 for two empty texts."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    x = np.frombuffer(short.encode(), np.uint8)
    y = np.frombuffer(long.encode(), np.uint8)
    weights = _weights()[: len(y)]
    equal = x == y[: len(x)]
    return float(weights[: len(x)][equal].sum() / weights.sum())


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, extra): in each task a stretch in descending key order, and at its end,
    marked extra, a copy of the row that follows it in the next stretch."""
    spark, parts = docs.sparkSession, tasks(docs.sparkSession)
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    shares = [i / parts for i in range(1, parts)]
    cuts = plain.agg(F.percentile_approx("key", shares or [0.5], 10000)).first()[0] or []
    cuts = sorted(set(cuts))  # at most one per task
    bound = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    part = F.when(F.col("key").isNull(), len(cuts)).otherwise(
        F.size(F.filter(bound, lambda b: F.col("key") < b))
    )
    plain = plain.withColumn("part", part)
    # The first row of each stretch: one key per task, then its first row by text.
    first = plain.groupBy("part").agg(F.max("key").alias("key")).collect()
    if not first:
        return plain.withColumn("extra", F.lit(False)).drop("part")
    used = sorted(r["part"] for r in first)
    before = dict(zip(used[1:] + used[:1], used))
    few = spark.createDataFrame(
        [(r["part"], r["key"], before[r["part"]]) for r in first],
        f"to_part int, first_key {plain.schema['key'].dataType.simpleString()}, before int",
    )
    heads = plain.join(
        F.broadcast(few),  # one row per task
        (plain["part"] == few["to_part"]) & plain["key"].eqNullSafe(few["first_key"]),
    )
    order = F.struct(F.xxhash64("text"), "text")
    heads = heads.groupBy("before").agg(F.min_by("text", order).alias("text"), F.max("key").alias("key"))
    every = plain.withColumn("extra", F.lit(False)).unionByName(
        heads.select("key", "text", F.col("before").alias("part"), F.lit(True).alias("extra"))
    )
    return (
        every.repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("extra", F.col("key").desc_nulls_last(), F.xxhash64("text"), "text")
        .select("key", "text", "extra")
    )


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its fingerprint, that of its edited text, and both likenesses.

    The next row is the one with the next smaller key, after the last the first; a
    table of one row follows itself. Rows with equal keys are ordered by a hash of
    their text, then their text; null keys come last. A null text counts as empty.
    Texts travel once, dealt by key ranges; other columns are not looked at. All rows
    with one key (or none) meet in one task.
    """
    columns = [
        "key",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    ]
    ordered = _in_order(docs, key, text)

    def finish(
        keys: pa.Array, many: list[str], prints: list[str], after: list[str], after_prints: list[str]
    ) -> pa.RecordBatch:
        new = [edited(t, n) for t, n in zip(many, after)]
        new_prints = fingerprints(new)
        hexes = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array([len(t) for t in many], pa.int64()),
                pa.array(hexes, pa.string()),
                pa.array(prints, pa.string()),
                pa.array(new_prints, pa.string()),
                pa.array([likeness(a, b) for a, b in zip(prints, new_prints)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(prints, after_prints)], pa.float64()),
            ],
            columns,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row seen: key, text, print, and whether it is an extra one
        for batch in sized(batches, 1, STRETCH):
            many = texts(batch.column(1))
            prints = fingerprints(many)
            keys, extra = batch.column(0), batch.column(2).to_pylist()
            if held is not None:
                yield finish(held[0], [held[1]], [held[2]], many[:1], prints[:1])
            real = len(many) - 1
            if real:
                yield finish(keys.slice(0, real), many[:-1], prints[:-1], many[1:], prints[1:])
            held = None if extra[-1] else (keys.slice(real, 1), many[-1], prints[-1])

    kind = ordered.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
    schema += "edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema).withColumnRenamed("key", key)


def distance(a: str, b: str, most: float = float("inf")) -> int:
    """Edit distance by whole-column bit vectors; any number above ``most`` once it is."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for left, c in zip(range(len(b), 0, -1), b):
        if score - left > most:  # a column changes the score by one at most
            return score - left
        equal = where.get(c, 0)
        x = equal | down
        h = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (full & ~(h | up)), up & h
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(x | plus)), plus & x
    return score


def near_duplicates(
    docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, class_id, links) of every row: classes of texts within an edit likeness.

    Bands of ROWS samples of a text's two longest doublings of its walk name buckets. In
    each bucket every text is a candidate with the bucket's smallest text hash, so a
    bucket of any size gives one candidate per member and no bucket is left out; a text
    has up to 2 * BANDS of them. A candidate links when 1 - edit distance / longer
    length reaches ``least``. Equal texts are one text. class_id is the smallest key of
    the class; null keys count as in a minimum.
    """
    plain = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("node", F.sha2("text", 256))
    members = stored(plain.select("key", "node"), "members")
    bodies = stored(plain.select("node", "text").dropDuplicates(["node"]), "bodies")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 1, STRETCH):
            nodes, out = batch.column(0).to_pylist(), []
            for node, mark in zip(nodes, fingerprints(texts(batch.column(1)))):
                firsts, at, k = [], 0, 0
                while at < len(mark):
                    firsts.append((k, mark[at : at + len(_octave(k))]))
                    at, k = at + len(_octave(k)), k + 1
                for k, part in firsts[-2:]:
                    size = max(1, min(ROWS, len(part)))
                    for b in range(min(BANDS, len(part) // size)):
                        out.append((f"{k}:{b}:{part[b * size : (b + 1) * size]}", node))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], ["bucket", "node"]
            )

    dealt = stored(bodies.mapInArrow(bands, "bucket string, node string"), "bands")
    head = dealt.groupBy("bucket").agg(F.min("node").alias("a"))
    pairs = dealt.join(head, "bucket").select("a", F.col("node").alias("b")).filter("a != b").distinct()
    sides = pairs.join(bodies.toDF("a", "text_a"), "a").join(bodies.toDF("b", "text_b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 2, STRETCH):
            both = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            keep = []
            for x, y in both:
                longer = max(len(x), len(y))
                near = min(len(x), len(y)) >= least * longer
                most = (1 - least) * longer + 1e-9
                keep.append(near and distance(x, y, most) <= most)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = sides.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a string, b string")
    links = stored(links, "links")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("links"))
    placed = (
        bodies.select("node")
        .join(components(links), "node", "left")
        .join(degree, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    every = stored(members.join(placed, "node"), "placed")
    least_key = every.groupBy("component").agg(F.min("key").alias("class_id"))
    return every.join(least_key, "component").select(F.col("key").alias(key), "class_id", "links")
