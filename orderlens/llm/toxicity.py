"""Toxicity by compression distance: two zstandard dictionaries, short windows.

Each class has a raw-content zstandard dictionary trained on its own texts: the forms (words
or beginnings of words) that are peculiar to the class, the most significant last, then the
words that are frequent in ordinary texts, which toxic texts use as well. A form is peculiar
by the likelihood ratio of its contexts in the two classes, so a small class needs fewer
contexts than a large one; copies of a text repeat its contexts, so its own rare words don't
qualify. A window of toxic words compresses shorter with the toxic dictionary, any other
window to nearly the same length with both. A logistic model of the excess lengths
calibrates the thresholds, fitted on texts measured with dictionaries that other texts
gave. Every window of a text is compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import fold, pieces, texts

WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")
TOXIC_DOCS, ORDINARY_DOCS = 1600, 3200  # the training sample holds at most so many
SAMPLE_CHARS = 20_000  # a longer text is not taken into the training sample
WINDOW = 192  # bytes
SHORTEST, LONGEST = 4, 10  # letters of a form
COMMON_BYTES = 1400  # room for the frequent words of a dictionary, as whole words
FORM_BYTES = 2048  # room for the forms of its class, as whole forms
COVERS = 6  # letters from which a form stands for the longer ones that begin with it
SIGNIFICANT = 27.0  # twice the logarithm of the likelihood ratio
FEWEST = 4  # contexts
REJECT = 0.7
LEVEL = 19


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def scorer(self) -> "Scorer":
        return Scorer(self)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        source_size=WINDOW,
        dict_size=len(content),
        min_match=3,
        hash_log=14,
        chain_log=14,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
    )
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def _plain(text: str) -> str:
    return " " + SPACE.sub(" ", text.lower()).strip() + " "


def windows(text: str) -> list[bytes]:
    """The whole text in pieces of at most WINDOW bytes, cut after a space where there is one."""
    data, out, at = _plain(text).encode("utf-8", "surrogatepass"), [], 0
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            space = data.rfind(b" ", at + WINDOW // 2, end)
            end = space + 1 if space > 0 else end
        out.append(data[at:end])
        at = end
    return out


class Scorer:
    """Both compressors, made once in each task."""

    def __init__(self, model: Model) -> None:
        self.by_toxic, self.by_ordinary = _compressor(model.toxic), _compressor(model.ordinary)
        self.weights = np.array(model.weights)

    def features(self, text: str) -> list[float]:
        """Largest excess lengths, their sum above noise, and the number of windows."""
        cut = windows(text)
        shorter, longer = self.by_toxic.compress, self.by_ordinary.compress
        excess = np.sort([len(longer(w)) - len(shorter(w)) for w in cut])[::-1]
        top = np.zeros(3)
        top[: min(3, len(excess))] = excess[:3]
        return [
            1.0,
            float(top[0]),
            float(top[0] + top[1]),
            float(top.sum()),
            float(np.log1p(np.maximum(excess - 2, 0).sum())),
            float(np.maximum(excess - 2, 0).sum() / len(cut)),
            float(np.log(len(cut))),
        ]

    def score(self, text: str) -> float:
        away = float(np.dot(self.weights, self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(away, -50, 50))))


def contexts(many: list[str]) -> Counter:
    """In how many different contexts (the word before) each form occurs."""
    seen = set()
    for text in many:
        words = WORD.findall(text.lower())
        for before, word in zip(["", *words], words):
            seen |= {(word[:k], before) for k in range(SHORTEST, min(len(word), LONGEST) + 1)}
    return Counter(form for form, _ in seen)


def forms(own: Counter, other: Counter, n_own: int, n_other: int) -> list[str]:
    """The forms peculiar to a class of ``n_own`` texts against ``n_other``, the most
    significant first.

    A beginning whose longer form has most of its contexts gives way to it, and a form
    that begins with a chosen long one is left out, as the chosen one matches it too.
    """
    share = n_own / (n_own + n_other)
    found = {}
    for form, n in own.items():
        m = other[form]
        if n < FEWEST or n * n_other <= 4 * m * n_own:
            continue
        ratio = n * math.log(n / ((n + m) * share))
        ratio += m * math.log(m / ((n + m) * (1 - share))) if m else 0
        if 2 * ratio > SIGNIFICANT:
            found[form] = (2 * ratio, n)
    inner = {
        form[:k]
        for form, (_, n) in found.items()
        for k in range(SHORTEST, len(form))
        if n > 0.8 * found.get(form[:k], (0, n * 2))[1]
    }
    picked: list[str] = []
    chosen = set()
    for form in sorted(found, key=lambda form: (-found[form][0], form)):
        if form not in inner and not any(form[:k] in chosen for k in range(COVERS, len(form))):
            chosen.add(form)
            picked.append(form)
    return picked


def fitting(words: list[str], room: int) -> list[str]:
    """The first words that fit into ``room`` bytes, whole and last first."""
    ends = np.cumsum([len(w.encode()) + 1 for w in words])
    return words[: int(np.searchsorted(ends, room, "right"))][::-1]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic weights by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty @ w
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The dictionary of each class, toxic first."""
    counts = Counter(w for text in ordinary for w in WORD.findall(text.lower()))
    usual = fitting(sorted(counts, key=lambda w: (-counts[w], w)), COMMON_BYTES)
    seen = contexts(toxic), contexts(ordinary)
    many = len(toxic), len(ordinary)
    made = []
    for own in (0, 1):
        picked = forms(seen[own], seen[1 - own], many[own], many[1 - own])
        # A match must be longer than the shortest forms are: the space after them helps.
        marks = [f + " " if len(f) == SHORTEST else f for f in fitting(picked, FORM_BYTES)]
        made.append((" " + " ".join([*marks, *usual]) + " ").encode().rjust(64))
    return made[0], made[1]


def fit(toxic: list[str], ordinary: list[str], weight: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Dictionaries from all texts, calibrated on texts they were not made from.

    Each half of the sample is measured with dictionaries of the other half; the
    logistic weights come from these. ``weight`` says how many labelled documents a
    toxic and an ordinary text of the sample stand for. Without two texts of each kind
    every score is 0.
    """
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b" " * 64, b" " * 64, (-50.0,) + (0.0,) * 6)
    x, y = [], []
    for half in (0, 1):
        held = _dictionaries(toxic[1 - half :: 2], ordinary[1 - half :: 2])
        scorer = Model(*held, (0.0,) * 7).scorer()
        x += [scorer.features(t) for t in toxic[half::2] + ordinary[half::2]]
        y += [1.0] * len(toxic[half::2]) + [0.0] * len(ordinary[half::2])
    marks = np.array(y)
    weights = _logistic(np.array(x), marks, np.where(marks == 1, *weight))
    return Model(*_dictionaries(toxic, ordinary), tuple(float(w) for w in weights))


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1)) -> Model:
    """Fit on labelled documents outside the held-out fold.

    The sample is bounded: TOXIC_DOCS and ORDINARY_DOCS texts of at most SAMPLE_CHARS
    characters, those with the smallest hash of their id. A document labelled more
    than once counts as toxic if any label says so; null labels and texts are left out.
    """
    spark, (folds, out) = docs.sparkSession, held_out
    marks = labels.filter("toxic is not null and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Ids and lengths travel, not texts; the texts of the few chosen ids are fetched last.
    known = docs.filter(F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != out))
    known = known.select("doc_id", F.length("text").alias("chars")).join(marks, "doc_id")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    short = known.filter(F.col("chars") <= SAMPLE_CHARS)

    def chosen(toxic: int, most: int) -> list[tuple[int, int]]:
        order = F.xxhash64("doc_id")
        rows = short.filter(F.col("toxic") == toxic).select("doc_id").distinct()
        rows = rows.orderBy(order, "doc_id").limit(most)
        return [(r["doc_id"], toxic) for r in rows.collect()]

    ids = chosen(1, TOXIC_DOCS) + chosen(0, ORDINARY_DOCS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = spark.createDataFrame(ids, f"doc_id {kind}, toxic int")
    sample = (
        docs.select("doc_id", "text")
        .filter(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(few), "doc_id")  # at most TOXIC_DOCS + ORDINARY_DOCS rows
        .groupBy("toxic", "doc_id")  # of rows with one id the smallest text
        .agg(F.min("text").alias("text"))
    )
    rows = sorted(tuple(r) for r in sample.collect())
    toxic = [t for mark, _, t in rows if mark == 1][:TOXIC_DOCS]
    ordinary = [t for mark, _, t in rows if mark == 0][:ORDINARY_DOCS]
    weight = (counts.get(1, 0) / max(1, len(toxic)), counts.get(0, 0) / max(1, len(ordinary)))
    total = len(toxic) * weight[0] + len(ordinary) * weight[1]
    scale = (len(toxic) + len(ordinary)) / max(1.0, total)
    return fit(toxic, ordinary, (weight[0] * scale, weight[1] * scale))


def scores(many: Iterable[str], scorer: Scorer) -> list[float]:
    return [scorer.score(t) for t in many]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, in the order of the input's partitions.

    A null or empty text has one empty window and scores low. Repeated rows score
    alike; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in pieces(batches, 512):
            got = pa.array(scores(texts(batch.column(1)), scorer), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), got], ["key", "score"])

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )


def keep_ordinary(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below REJECT."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in pieces(batches, 512):
            many = [str(t) for t in texts(batch.column(at))]
            yield batch.filter(pa.array([s < REJECT for s in scores(many, scorer)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
