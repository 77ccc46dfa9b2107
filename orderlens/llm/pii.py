"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans, which always stay. The field's nodes are the units of a
text that could be personal data: words around an @ and runs of digits with their
separators. Node potentials are a softmax of a unit's shape; units one after another
share chain potentials; units with the same characters, the same last seven digits or the
same words around their @ share skip potentials, however far apart they stand. Base spans
are evidence. Loopy message passing carries it through a document, and units that end up
with a kind at least SURE join the spans, so a number that was once written in full is
found again where its prefix is missing.

All weights are learned from the base spans of a bounded sample of documents. There a unit
without a base span counts as other text only if it has no skip link to one with a span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import sized, texts

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9])*")
DIGIT = re.compile(r"[0-9]")
NEAR = 40  # characters between units of a chain
SURE = 0.9
FLOOR = -2.5  # the least node potential below the best
ROUNDS = 12
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 20_000  # bounds of the training sample
STRETCH = 4 << 20

Span = tuple[int, int, int]  # kind, start, end


def digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the whole pattern leftmost would match, in linear time: from each @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each run of dotted numbers."""
    for run in DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(1, a, b) for a, b in _addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits(m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [
                (3, m.start(), m.end())
                for m in PHONE.finditer(text)
                if 9 <= len(digits(m[0])) <= 15
            ]
    return out


@dataclass
class Unit:
    start: int
    end: int
    text: str
    label: int  # 0 for none, else kind + 1


def units(text: str, base: list[Span]) -> list[Unit]:
    """Base spans and, apart from them, words around an @ and runs of digits."""
    taken: list[tuple[int, int, int]] = []
    for kind, a, b in sorted(base, key=lambda s: (s[1], -s[2], s[0])):
        if not taken or a >= taken[-1][1]:
            taken.append((a, b, kind + 1))
    found = list(taken)
    at, free = text.find("@"), 0
    while at >= 0:
        start, end = at, at + 1
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        while end < len(text) and text[end] in LOCAL:
            end += 1
        if start < at and end > at + 1:
            found.append((start, end, 0))
        free = end
        at = text.find("@", end)
    found += [(m.start(), m.end(), 0) for m in NUMBER.finditer(text)]
    out: list[Unit] = []
    # A base span beats what overlaps it, then the earlier and longer unit.
    spans = iter([*taken, (len(text) + 1, len(text) + 1, 0)])
    ahead, last = next(spans), 0
    for a, b, label in sorted(set(found), key=lambda s: (s[0], s[2] == 0, -s[1])):
        while ahead[1] <= a:
            ahead = next(spans)
        clear = label or b <= ahead[0]
        if a >= last and clear:
            out.append(Unit(a, b, text[a:b], label))
            last = b
    return out


def _shape(unit: Unit) -> list[float]:
    """What the node potentials see of a unit; nothing that names one person."""
    number = digits(unit.text)
    n, local = len(number), "@" in unit.text
    parts = unit.text.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts)
    domain = local and "." in unit.text.rpartition("@")[2].strip(".")
    return [
        1.0,
        float(local),
        float(domain),
        float(quad),
        float(unit.text.startswith("+")),
        float("(" in unit.text),
        float(" " in unit.text or "-" in unit.text),
        float(n <= 6),
        float(7 <= n <= 8),
        float(9 <= n <= 12),
        float(13 <= n <= 15),
        float(16 <= n <= 19),
        float(13 <= n <= 19 and luhn(number)),
    ]


def _keys(unit: Unit) -> list[str]:
    """Units that share one of these are similar."""
    if "@" in unit.text:
        local, _, domain = unit.text.lower().rpartition("@")
        return [f"a {local}@{domain.partition('.')[0]}"]
    number = digits(unit.text)
    return [f"n {number[-7:]}"] if len(number) >= 7 else []


def edges(many: list[Unit]) -> list[tuple[int, int, int]]:
    """(unit, unit, 0 for chain or 1 for skip). A group of similar units is linked one to
    the next, so links grow with the units and not with their pairs."""
    out = [
        (i, i + 1, 0) for i in range(len(many) - 1) if many[i + 1].start - many[i].end <= NEAR
    ]
    last: dict[str, int] = {}
    for i, unit in enumerate(many):
        for key in _keys(unit):
            if key in last:
                out.append((last[key], i, 1))
            last[key] = i
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # shape features x labels
    pairs: np.ndarray  # log potentials of chain and skip links


def fit(many: list[str]) -> Model:
    """Node weights by a ridge-penalised softmax, pair potentials from label counts."""
    labels = len(KINDS) + 1
    x, y = [], []
    counts = np.ones((2, labels, labels)) * 0.5
    counts[1] += 100 * np.eye(labels)  # similar units agree unless the sample says otherwise
    for text in many:
        held = units(text, base_spans(text))
        links = edges(held)
        unsure = {j if held[i].label else i for i, j, k in links if k and bool(held[i].label) != bool(held[j].label)}
        for i, unit in enumerate(held):
            if i not in unsure:
                x.append(_shape(unit))
                y.append(unit.label)
        for i, j, k in links:
            if i not in unsure and j not in unsure:
                counts[k, held[i].label, held[j].label] += 1
                counts[k, held[j].label, held[i].label] += 1
    joint = counts / counts.sum(axis=(1, 2), keepdims=True)
    alone = joint.sum(axis=2)
    pairs = np.clip(np.log(joint / (alone[:, :, None] * alone[:, None, :])), -8, 8)
    pairs[0] = np.clip(pairs[0], -1, 1)
    shapes, marks = np.array(x or [[1.0] + [0.0] * 12]), np.array(y or [0])
    weights = np.zeros((shapes.shape[1], labels))
    wanted = np.eye(labels)[marks]
    for _ in range(400):
        score = shapes @ weights
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights -= 2.0 * (shapes.T @ (p - wanted) / len(shapes) + 1e-3 * weights)
    return Model(weights, pairs)


def marginals(
    model: Model, nodes: list[Unit], links: list[tuple[int, int, int]]
) -> np.ndarray:
    """Label probabilities of all units, by sum-product messages in ROUNDS sweeps."""
    shapes = np.array([_shape(u) for u in nodes])
    own = shapes @ model.weights
    own -= own.max(axis=1, keepdims=True)
    own = np.maximum(own, FLOOR)  # no shape alone rules a label out
    fixed = np.array([u.label for u in nodes])
    seen = fixed > 0
    own[seen] = -30
    own[seen, fixed[seen]] = 0
    if links:
        a, b, kind = np.array(links).T
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        table = np.exp(model.pairs)[np.concatenate([kind, kind])]
        sent = np.zeros((len(source), own.shape[1]))
        for _ in range(ROUNDS):
            total = own.copy()
            np.add.at(total, target, sent)
            cavity = total[source] - sent[back]
            cavity -= cavity.max(axis=1, keepdims=True)
            new = np.log(np.einsum("el,elm->em", np.exp(cavity), table) + 1e-30)
            new -= new.max(axis=1, keepdims=True)
            sent = 0.5 * sent + 0.5 * new
        total = own.copy()
        np.add.at(total, target, sent)
    else:
        total = own
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _fits(kind: int, unit: Unit) -> bool:
    """Whether a unit can be of a kind at all."""
    n, local = len(digits(unit.text)), "@" in unit.text
    if kind == 0:
        return local
    if kind == 1:
        return not local and unit.text.count(".") == 3
    return not local and (13 <= n <= 19 if kind == 2 else 7 <= n <= 15)


def spans(many: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; the fields of all texts run together."""
    base = [base_spans(t) for t in many]
    nodes: list[Unit] = []
    owner: list[int] = []
    links: list[tuple[int, int, int]] = []
    for row, (text, own) in enumerate(zip(many, base)):
        # Without evidence there is nothing that skip links could carry.
        if own:
            held = units(text, own)
            links += [(i + len(nodes), j + len(nodes), k) for i, j, k in edges(held)]
            nodes += held
            owner += [row] * len(held)
    every = [list(b) for b in base]
    if nodes:
        p = marginals(model, nodes, links)
        best = p.argmax(axis=1)
        for i in np.flatnonzero((best > 0) & (p.max(axis=1) >= SURE)):
            unit, kind = nodes[i], int(best[i]) - 1
            if not unit.label and _fits(kind, unit):
                every[owner[i]].append((kind, unit.start, unit.end))
    return [(b, sorted(e)) for b, e in zip(base, every)]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most SAMPLE_DOCS texts of at most SAMPLE_CHARS characters with a digit or
    an @, those with the smallest hash of their key."""
    spark = docs.sparkSession
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    plain = plain.filter((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]"))
    order = F.xxhash64("key")
    few = plain.select("key").distinct().orderBy(order, "key").limit(SAMPLE_DOCS).collect()
    kind = plain.schema["key"].dataType.simpleString()
    ids = spark.createDataFrame([(r["key"],) for r in few], f"key {kind}")
    sample = plain.join(F.broadcast(ids), plain["key"].eqNullSafe(ids["key"]))  # SAMPLE_DOCS rows
    rows = sample.groupBy(plain["key"]).agg(F.min("text").alias("text")).collect()  # one an id
    return fit([r["text"] for r in sorted(rows, key=lambda r: (r["key"] is not None, r["key"]))])


def shown(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def detect(
    docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Counts and digest are of the base spans, ``spans`` has the added ones too. A null
    text is empty. Repeated rows come back as often as they are; other columns are not
    looked at.
    """
    model = model or train(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 1, STRETCH):
            got = spans(texts(batch.column(1)), model)
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in got], pa.int64()) for k in range(4)]
            hexes = [hashlib.sha256(shown(b).encode()).hexdigest() for b, _ in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *counts,
                    pa.array(hexes, pa.string()),
                    pa.array([shown(e) for _, e in got], pa.string()),
                ],
                ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    out = plain.mapInArrow(run, schema + "base_sha256 string, spans string")
    return out.withColumnRenamed("key", key)


def masked(text: str, found: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with every span of ``text`` masked by its kind.

    A null text stays null; every row comes back.
    """
    model, names, at = train(docs, key, text), docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, at, STRETCH):
            old = batch.column(at).to_pylist()
            got = spans([t or "" for t in old], model)
            new = [t and masked(t, every) for t, (_, every) in zip(old, got)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
