"""SimHash near-duplicates: vantage-point partitions of the Hamming space.

A fingerprint of ``64 * words`` bits is cut into segments. Two fingerprints that
differ in at most ``radius`` bits differ in at most ``radius // segments`` bits of
one segment (pigeonhole), so one tree per segment finds every pair.

A tree's levels are vantage points of the segment's Hamming space. A fingerprint
lies in the shard named by its distances to them. By the triangle inequality a
partner within ``slack`` bits of the segment lies at most ``slack`` further from or
nearer to each vantage point, and every flipped bit moves all these distances by
one, so they change with the same parity: the other shells are pruned. Each
fingerprint is at home in one shard per tree and visits the shards beyond its own
that its ball overlaps, each pair of shards once. Inside a shard a further vantage
point orders the fingerprints and bounds which of them are compared.

A shard answers with a minimum spanning forest of its links, so a group of n near
copies yields n - 1 links, not all pairs; the links at or below any distance still
connect the same fingerprints. A shard with more than ``hot`` fingerprints is cut
into blocks, and every pair of blocks meets in a task of its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import groups, pieces, stored, tasks, texts
from orderlens.llm.components import components

SEED = 42
SHARD = 4096  # fingerprints a shard should hold on average
HOT = 32768  # beyond it a shard is cut into blocks
COMPARED = 1 << 17  # pairs compared in one step
LEVELS = 6


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; A-Z lower-cased, ASCII space splits."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.array([digest(whole[a:b], SEED) for a, b in cuts], np.uint64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """An independent 64-bit hash of each hash (SplitMix64 steps); word 0 is the hash itself."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(word) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> str:
    """Majority of each bit as hex; zero for no shingles."""
    out = []
    for word in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65536):
            part = _mixed(hashes[at : at + 65536], word).astype(">u8").view(np.uint8)
            ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)).tobytes().hex())
    return "".join(out)


def fingerprints(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    words: int = 1,
) -> DataFrame:
    """(key, fingerprint, n_shingles) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            hashed = [shingle_hashes(t, shingle) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([fingerprint(h, words) for h in hashed], pa.string()),
                    pa.array([len(h) for h in hashed], pa.int64()),
                ],
                ["key", "fingerprint", "n_shingles"],
            )

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(run, f"key {kind}, fingerprint string, n_shingles bigint")


def _words(hexes: list[str], words: int) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(hexes)), ">u8").astype(np.uint64).reshape(-1, words)


def _vantage(bits: int, segments: int, levels: int) -> list[tuple[slice, np.ndarray]]:
    """Per tree its bits and its vantage points, the same in every task."""
    edges = np.linspace(0, bits, segments + 1).round().astype(int)
    draw = np.random.default_rng(SEED)
    return [
        (slice(a, b), draw.integers(0, 2, (levels, b - a), dtype=np.uint8))
        for a, b in itertools.pairwise(edges.tolist())
    ]


def _shifts(levels: int, slack: int) -> list[tuple[int, ...]]:
    """How the distances to the vantage points can differ; of two opposite shifts one."""
    found = set()
    for bits in range(1, slack + 1):
        steps = range(-bits, bits + 1, 2)
        found |= {s for s in itertools.product(steps, repeat=levels) if s > (0,) * levels}
    return sorted(found)


def route(items: DataFrame, words: int, segments: int, slack: int, levels: int) -> DataFrame:
    """(cell, home, fingerprint): one home shard per tree and the shards visited."""
    trees = _vantage(64 * words, segments, levels)
    shifts = _shifts(levels, slack)
    place = 65 ** np.arange(levels, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8192):
            column = batch.column(0)
            bits = np.unpackbits(
                _words(column.to_pylist(), words).astype(">u8").view(np.uint8), axis=None
            ).reshape(-1, 64 * words)
            for tree, (part, points) in enumerate(trees):
                seen = bits[:, part]
                far = np.stack([(seen ^ p).sum(axis=1, dtype=np.int64) for p in points], axis=1)
                top = seen.shape[1]
                for shift in [(0,) * levels, *shifts]:
                    near = far + np.array(shift)
                    rows = np.flatnonzero(((near >= 0) & (near <= top)).all(axis=1))
                    cell = (near[rows] * place).sum(axis=1) * len(trees) + tree
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cell, pa.int64()),
                            pa.array(np.full(len(rows), not any(shift))),
                            column.take(pa.array(rows)),
                        ],
                        ["cell", "home", "fingerprint"],
                    )

    return items.select("fingerprint").mapInArrow(
        run, "cell bigint, home boolean, fingerprint string"
    )


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the given pairs: the smallest label of each group."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of the links of a minimum spanning forest; ties by position of the ends."""
    order = np.lexsort((b, a, d))
    a, b = a[order], b[order]
    label, left, kept = np.arange(n), np.arange(len(a)), []
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return order[np.concatenate(kept)] if kept else order[:0]
        best = np.full(n, len(a))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        pick = np.unique(best[best < len(a)])
        kept.append(pick)
        label = _merged(label, a[pick], b[pick])


def shard_links(
    own: np.ndarray, guests: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, distance) within ``radius`` that span what a shard's rows link.

    Positions count the own fingerprints first, then the guests. Own ones are
    compared with each other and with the guests, in steps of bounded size.
    """
    every = np.concatenate([own, guests])
    n, m = len(every), len(own)
    nothing = np.zeros(0, np.int64)
    if not m:
        return nothing, nothing, nothing
    away = np.bitwise_count(every ^ every[0]).sum(axis=1, dtype=np.int64)
    home = np.argsort(away[:m], kind="stable")
    guest = m + np.argsort(away[m:], kind="stable")
    near_home, near_guest = away[home], away[guest]

    def compared() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, those the triangle bound leaves to compare them with, and the distances."""
        step, start = max(1, COMPARED // n), 0
        while start < m:
            end = min(m, start + step)
            lo, hi = near_home[start] - radius, near_home[end - 1] + radius
            mates = home[start : np.searchsorted(near_home, hi, "right")]
            others = slice(np.searchsorted(near_guest, lo), np.searchsorted(near_guest, hi, "right"))
            left, right = home[start:end], np.concatenate([mates, guest[others]])
            far = sum(
                np.bitwise_count(every[left, w][:, None] ^ every[right, w][None, :]).astype(np.int16)
                for w in range(every.shape[1])
            )
            yield left, right, far
            start = end

    a = b = d = nothing
    for left, right, far in compared():
        i, j = np.nonzero(far <= radius)
        ahead = j > i  # the first columns are the rows themselves
        i, j = i[ahead], j[ahead]
        a = np.concatenate([a, left[i]])
        b = np.concatenate([b, right[j]])
        d = np.concatenate([d, far[i, j].astype(np.int64)])
        if len(a) > 4 * n + COMPARED:
            pick = forest(n, a, b, d)
            a, b, d = a[pick], b[pick], d[pick]
    pick = forest(n, a, b, d)
    return a[pick], b[pick], d[pick]


def links(
    items: DataFrame,
    words: int,
    radius: int,
    segments: int,
    slack: int | None = None,
    shard: int = SHARD,
) -> DataFrame:
    """(a, b, distance): links between distinct fingerprints that span the near ones.

    With ``slack`` left out, or (slack + 1) * segments above ``radius``, no near pair
    is missed; a smaller one trades completeness for fewer comparisons. ``shard`` is the
    size that shards should have on average: larger ones take more comparisons, smaller
    ones more levels, and with each level a fingerprint visits twice as many.
    """
    spark = items.sparkSession
    slack = radius // segments if slack is None else slack
    levels = max(1, math.ceil(math.log(max(1, items.count()) / shard, 5)))
    routed = route(items, words, segments, slack, min(levels, LEVELS))
    crowds = routed.filter("home").groupBy("cell").agg(F.count("*").alias("n"))
    crowds = crowds.filter(F.col("n") > HOT).select(
        "cell", F.ceil(F.col("n") / HOT).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    others = F.expr("sequence(0, coalesce(blocks, 1) - 1)")
    meets = F.when(
        F.col("home") & F.col("blocks").isNotNull(),
        F.transform(
            others,
            lambda j: F.struct(
                (F.least(block, j) * F.col("blocks") + F.greatest(block, j)).alias("sub"),
                (j >= block).alias("home"),
            ),
        ),
    ).otherwise(
        F.transform(
            others,
            lambda j: F.struct(
                (j.cast("bigint") * (F.coalesce(F.col("blocks"), F.lit(1)) + 1)).alias("sub"),
                F.col("home").alias("home"),
            ),
        )
    )
    dealt = routed.join(stored(crowds, "crowds"), "cell", "left").select(
        "cell", "fingerprint", F.explode(meets).alias("meet")
    )
    dealt = dealt.select(
        (F.col("cell") * (1 << 20) + F.col("meet.sub")).alias("shard"),
        F.col("meet.home").alias("home"),
        "fingerprint",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in groups(batches, "shard"):
            home = shard.column("home").to_numpy()
            names = shard.column("fingerprint").combine_chunks()
            if not home.any() or len(home) < 2:
                continue
            every = _words(names.to_pylist(), words)
            at = np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)])
            a, b, d = shard_links(every[home], every[~home], radius)
            if len(a):
                x, y = names.take(pa.array(at[a])), names.take(pa.array(at[b]))
                yield pa.RecordBatch.from_arrays(
                    [x, y, pa.array(d, pa.int64())], ["a", "b", "distance"]
                )

    found = (
        dealt.repartition(tasks(spark), "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(run, "a string, b string, distance bigint")
    )
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance"]
    return found.select(*ends).distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest key reachable over links. Null, empty and blank texts have fingerprint
    zero and link like any other; texts of fewer words than a shingle are one
    shingle. Repeated rows come back as often as they are. A null key takes part in
    linking and can't be a component_id (null where a component has no other).
    Other columns of the input are not looked at.
    """
    printed = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = stored(
        printed.groupBy("fingerprint").agg(F.min("key").alias("least_key")), "distinct"
    )
    # Four trees have segments of 16 bits with one bit of slack and cut less than three
    # of about 21 bits, which are enough for a radius of up to 5.
    trees = max(1, (radius + 2) // 2)
    found = components(links(distinct, 1, radius, trees))
    placed = distinct.join(
        found.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left"
    ).withColumn("component", F.coalesce("component", "fingerprint"))
    least = placed.groupBy("component").agg(F.min("least_key").alias("component_id"))
    named = placed.join(least, "component").select("fingerprint", "component_id")
    return printed.join(named, "fingerprint").select(
        F.col("key").alias(key), "fingerprint", "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: one document of each group stays.

    Groups are the components of ``near_duplicates`` with its own shingles and radius.
    Of a group the row with the smallest key stays (null keys last, then by a digest of
    the text); of rows that repeat it, the one whose columns have the smallest hash.
    Null, empty and blank texts have fingerprint zero and link like any other.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.struct(
        F.col(key).isNull().alias("unnamed"), F.col(key).alias("id"), F.md5(body).alias("digest")
    )

    def label(of: Column) -> Column:
        return F.concat_ws("\n", of["digest"], of["id"].cast("string"))

    named = near_duplicates(docs.select(name.alias("name"), body.alias("text")), "name", "text")
    heads = named.select("component_id").distinct()
    chosen = heads.select(label(F.col("component_id")).alias("label"))
    marked = docs.select(
        F.struct(*[F.col(n) for n in docs.columns]).alias("row"), label(name).alias("label")
    )
    same = Window.partitionBy("label").orderBy(F.xxhash64("row"))
    kept = marked.join(chosen, "label", "left_semi").withColumn("place", F.row_number().over(same))
    return kept.filter("place = 1").select("row.*")
