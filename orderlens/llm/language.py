"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS entries of +1 or -1, the same in every
task. An n-gram of three letters binds them: the product of the first letter's vector
permuted twice, the second's permuted once and the third's. A text is the bundle (sum) of
its n-grams, and so is a language of those of its training texts, over all of them. A
text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import fold, sized, texts

DIMENSIONS = 1024
SEED = 5
STRETCH = 4 << 20  # bytes of text whose n-grams are bound together
ROWS = 256  # texts bundled in one product
UNKNOWN = "und"
OTHER = regex.compile(r"[^\p{L}]+")


SLICE = 1 << 13  # n-grams bound at once


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # a row per language, of length 1


@lru_cache(maxsize=1 << 14)
def letter(point: int) -> np.ndarray:
    """The vector of a letter, by its code point."""
    draw = np.random.default_rng([SEED, point])
    return (draw.integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers: letters in lower case, a space between words."""
    words = OTHER.sub(" ", text.lower()).strip()
    if not words:
        return np.zeros(0, np.int64)
    data = f" {words} ".encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(data, "<u4").astype(np.int64)
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]


def bind(keys: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 per n-gram."""
    mask = (1 << 21) - 1
    three = np.stack([keys >> 42, keys >> 21 & mask, keys & mask])
    points, place = np.unique(three, return_inverse=True)
    place = place.reshape(three.shape)
    base = np.stack([letter(int(p)) for p in points])
    out = np.roll(base, 2, axis=1)[place[0]]
    out *= np.roll(base, 1, axis=1)[place[1]]
    out *= base[place[2]]
    return out


def bundles(many: list[str]) -> Iterator[np.ndarray]:
    """The vectors of the texts, ROWS at a time; zero for a text without letters."""
    for at in range(0, len(many), ROWS):
        held = [grams(t) for t in many[at : at + ROWS]]
        sizes = [len(h) for h in held]
        out = np.zeros((len(held), DIMENSIONS), np.float32)
        if sum(sizes):
            keys = np.concatenate(held)
            rows = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
            held = []
            order = np.argsort(keys, kind="stable")
            keys, rows = keys[order], rows[order]
            fresh = np.append(0, np.flatnonzero(np.diff(keys)) + 1)
            # Counts are a table for a slice of the n-grams at a time, dense but small.
            for start in range(0, len(fresh), SLICE):
                heads = fresh[start : start + SLICE]
                stop = fresh[start + SLICE] if start + SLICE < len(fresh) else len(keys)
                first = heads[0]
                column = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, stop)))
                cells = rows[first:stop].astype(np.int64) * len(heads) + column
                counts = np.bincount(cells, minlength=len(out) * len(heads))
                counts = counts.reshape(len(out), -1).astype(np.float32)
                out += counts @ bind(keys[heads]).astype(np.float32)
        yield out


def train(known: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Prototypes of all non-null values of ``lang``, from every text of ``known``.

    Each task adds up the n-grams of its texts by language and binds them once; one
    vector per task and language travels, and one per language reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        total: dict[str, np.ndarray] = {}

        def spill(name: str) -> None:
            found = counts.pop(name)
            keys = np.fromiter(found.keys(), np.int64, len(found))
            many = np.fromiter(found.values(), np.float64, len(found))
            into = total.setdefault(name, np.zeros(DIMENSIONS))
            for start in range(0, len(keys), 1 << 14):
                part = slice(start, start + (1 << 14))
                into += many[part] @ bind(keys[part])

        for batch in sized(batches, 0, STRETCH):
            by: dict[str, list[np.ndarray]] = {}
            for body, name in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(grams(body))
            for name, held in by.items():
                keys, many = np.unique(np.concatenate(held), return_counts=True)
                count = counts.setdefault(name, Counter())
                count.update(dict(zip(keys.tolist(), many.tolist())))
                if len(count) > 1 << 19:
                    spill(name)
        for name in list(counts):
            spill(name)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([total[n] for n in names], pa.list_(pa.float64())),
            ],
            ["lang", "vector"],
        )

    plain = known.select(F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    plain = plain.filter("text is not null and lang is not null")
    sums = plain.mapInArrow(run, "lang string, vector array<double>")
    sums = sums.select("lang", F.posexplode("vector").alias("place", "value"))
    sums = sums.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors: dict[str, np.ndarray] = {}
    for r in sums.collect():  # DIMENSIONS numbers per language
        vectors.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["place"]] = r["value"]
    names = sorted(n for n, v in vectors.items() if v.any())
    rows = [vectors[n] / np.linalg.norm(vectors[n]) for n in names]
    return Model(tuple(names), np.array(rows, np.float32).reshape(len(names), DIMENSIONS))


def predict(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, lang_pred, score): the nearest language and the cosine, at least 0.

    A text that is null or has no letter is ``und`` with score 0, and so is any text if
    nothing was learned. Of equally near languages the first by name is taken. Repeated
    rows come back as often as they are; other columns are not looked at.
    """
    names = [*model.languages, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 1, STRETCH):
            at = 0
            for vectors in bundles(texts(batch.column(1))):
                size = np.linalg.norm(vectors, axis=1)
                pick, score = np.full(len(vectors), len(names) - 1), np.zeros(len(vectors))
                if len(names) > 1:
                    near = vectors @ model.prototypes.T / np.maximum(size, 1e-9)[:, None]
                    has = size > 0
                    pick[has] = near[has].argmax(axis=1)
                    score[has] = np.clip(near[has].max(axis=1), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(vectors)),
                        pa.array([names[p] for p in pick], pa.string()),
                        pa.array(score, pa.float64()),
                    ],
                    ["key", "lang_pred", "score"],
                )
                at += len(vectors)

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    out = plain.mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("key", key)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents outside fold 2 of 4."""
    held_out = fold(F.col("doc_id"), 4) == 2
    got = predict(docs, train(docs.filter(~held_out)))
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
