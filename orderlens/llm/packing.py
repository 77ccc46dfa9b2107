"""Mixture-controlled packing: deficit round-robin over source queues.

Each source has a queue of its documents' tokens. Every mixing window credits each
queue with its share of WINDOW tokens; the queue serves the whole tokens of its credit
and carries the fraction as its deficit into the next window. With shares in whole
numbers the tokens served before window w are floor(w * WINDOW * share / all shares),
so any partition knows all deficits at any window without running the ones before it:
a queue position alone gives the window and the place in the packed stream. When a
queue runs dry, a new phase begins with the rest. The stream is cut every ``length``
tokens into sequences, so only the last one has padding.

Documents are tokenized once, into a written table that keeps each task's running
count per source. Offsets of the tasks' shares of a queue are prefix sums over one row
per task and source; no text or token is shuffled, however large one source is.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pieces, stored, texts

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary as ranks, for a faster encoder
LENGTH = 1024
WINDOW = 16 * LENGTH  # tokens over which the mixture holds
END = 0  # the id after each document


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Coder:
    """Ids as the tokenizers library gives them for VOCABULARY, special strings included."""

    def __init__(self, vocabulary: str, ranks: str) -> None:
        import tiktoken

        with open(ranks, "rb") as file:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        with open(vocabulary, encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.size = max([*known.values(), *special.values()]) + 1
        self.vocabulary, self.library = vocabulary, None
        self.fast = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special
        )

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # its pattern can run out of stack on endless runs of one class
            self.library = self.library or load(self.vocabulary)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@dataclass(frozen=True)
class Phase:
    """Windows during which the same queues are served."""

    first: int  # stream position
    windows: int
    served: tuple[int, ...]  # tokens per queue before this phase
    shares: tuple[int, ...]


class Mixture:
    """The schedule: a function from queue positions to stream positions."""

    def __init__(
        self, sizes: list[int], shares: list[int] | None = None, window: int = WINDOW
    ) -> None:
        """``shares`` are whole numbers; without them each queue has its share of all tokens."""
        self.sizes, self.window = tuple(sizes), window
        self.phases: list[Phase] = []
        wanted = [max(0, s) for s in (shares or sizes)]
        served = [0] * len(sizes)
        while sum(served) < sum(sizes):
            live = [w if s < n else 0 for w, s, n in zip(wanted, served, sizes)]
            if not any(live):  # only queues without a share are left
                live = [n - s for s, n in zip(served, sizes)]
            total = sum(live)
            windows = min(
                -(-(n - s) * total // (w * window)) for w, s, n in zip(live, served, sizes) if w
            )
            phase = Phase(sum(served), windows, tuple(served), tuple(live))
            self.phases.append(phase)
            served = self._served(phase, windows)

    def _served(self, phase: Phase, window: int) -> list[int]:
        total, credit = sum(phase.shares), window * self.window
        return [
            min(n, s + credit * w // total)
            for n, s, w in zip(self.sizes, phase.served, phase.shares)
        ]

    def place(self, queue: int, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(queue position, tokens, stream position) of the runs of a stretch of a queue."""
        for at, phase in enumerate(self.phases):
            last = at + 1 == len(self.phases)
            limit = self.sizes[queue] if last else self.phases[at + 1].served[queue]
            if start >= limit or start >= end:
                continue
            share, total = phase.shares[queue], sum(phase.shares)
            while start < min(end, limit):
                ahead = start - phase.served[queue] + 1
                window = -(-ahead * total // (share * self.window)) - 1
                before, after = self._served(phase, window), self._served(phase, window + 1)
                stop = min(end, after[queue])
                stream = sum(before) + sum(after[:queue]) - sum(before[:queue])
                yield start, stop - start, stream + start - before[queue]
                start = stop


def tokenized(
    docs: DataFrame, vocabulary: str, ranks: str, key: str, text: str, source: str
) -> DataFrame:
    """(task, source, key, start, ids): the tokens, and where in the task's share of its
    source they start. Written once, so that every reader sees the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary, ranks)
        task, count = TaskContext.get().partitionId(), defaultdict(int)
        for batch in pieces(batches, 128):
            names, starts, data = batch.column(2).to_pylist(), [], []
            for name, body in zip(names, texts(batch.column(1))):
                starts.append(count[name])
                ids = np.append(coder.ids(body), np.uint32(END))
                count[name] += len(ids)
                data.append(ids.astype("<u2" if wide == 2 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task] * batch.num_rows, pa.int64()),
                    batch.column(2),
                    batch.column(0),
                    pa.array(starts, pa.int64()),
                    pa.array(data, pa.binary()),
                    pa.array([len(d) // wide for d in data], pa.int64()),
                ],
                ["task", "source", "key", "start", "ids", "tokens"],
            )

    wide = 2 if Coder(vocabulary, ranks).size <= 1 << 16 else 4
    plain = docs.select(
        F.col(key).alias("key"),
        F.col(text).cast("string").alias("text"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
    )
    kind = plain.schema["key"].dataType.simpleString()
    schema = f"task bigint, source string, key {kind}, start bigint, ids binary, tokens bigint"
    return stored(plain.mapInArrow(run, schema).withColumn("wide", F.lit(wide)), "tokens")


def pack(
    docs: DataFrame,
    shares: Mapping[str, int] | None = None,
    length: int = LENGTH,
    window: int = WINDOW,
    vocabulary: str | None = None,
    ranks: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per piece: where its ids lie in the document and in which sequence.

    ``shares`` are target proportions in whole numbers by source; a source that isn't
    named is served when the named ones are done. Without them every window has the
    proportions of the whole corpus. A null text is empty and still has its end token; a
    null source shares the queue of the empty name; null and repeated keys and repeated
    rows are packed like any other, each row on its own. Other columns are not looked at.
    The schedule has one number per source and is meant for up to some thousand sources.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    coded = tokenized(docs, vocabulary, ranks or public_tokenizers.path(RANKS), key, text, source)
    parts = coded.groupBy("task", "source").agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(
        parts.withColumn("first", F.coalesce(F.sum("tokens").over(order), F.lit(0))), "parts"
    )
    sizes = {
        r["source"]: r["n"]
        for r in parts.groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    }
    names = sorted(sizes)
    mixture = Mixture(
        [sizes[n] for n in names], shares and [shares.get(n, 0) for n in names], window
    )
    queue = {n: i for i, n in enumerate(names)}
    kinds = coded.schema["key"].dataType.simpleString()
    # One row per task and source, some bytes each; the planner broadcasts it by its file size.
    placed = coded.join(parts.select("task", "source", "first"), ["task", "source"]).select(
        "key", "source", (F.col("first") + F.col("start")).alias("at"), "ids", "wide"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            rows, out = [], []
            columns = [batch.column(i).to_pylist() for i in (1, 2, 3, 4)]
            for row, (name, at, data, wide) in enumerate(zip(*columns)):
                ids = np.frombuffer(data, "<u2" if wide == 2 else "<u4").astype("<u4")
                for start, many, stream in mixture.place(queue[name], at, at + len(ids)):
                    while many:
                        size = min(many, length - stream % length)
                        cut = ids[start - at : start - at + size]
                        rows.append(row)
                        out.append(
                            (
                                start - at,
                                size,
                                zlib.crc32(cut.tobytes()),
                                len(ids),
                                stream // length,
                                stream % length,
                            )
                        )
                        start, many, stream = start + size, many - size, stream + size
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), *columns],
                ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    schema = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    schema = f"key {kinds}, {schema}sequence_id bigint, offset bigint"
    if not names:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    return placed.mapInArrow(run, schema).withColumnRenamed("key", key)
