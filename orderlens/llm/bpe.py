"""Byte-pair encoding with a pair occurrence index, and decoding.

The distinct words of a stretch of a partition are laid out as one array of symbols.
An index maps the rank of each pair that has a merge to the positions where the pair
stands. Ranks are applied in ascending order: all positions of the lowest active rank
merge at once, left to right, and only the lists of the pairs beside them change; a
list may hold a position whose symbols have changed meanwhile, which is then passed
over. Words don't touch each other, so this gives each word the merges it would get
alone. Documents are put together from the ids of their words. Texts are split by a regular
expression; where a text has a code point that Python's tables do not know, and which
other tables may class otherwise, the vocabulary's own normalizer and splitter do it.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import sized, texts

VOCABULARY = "word_bpe_49k.json"
STRETCH = 8 << 20  # bytes of text whose distinct words are indexed together
NONE = np.iinfo(np.int64).max
MARKS = "\u0334\u0323\u0301"  # of canonical classes 1, 220 and 230


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = itertools.count(256)
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


class Codec:
    """A byte-level BPE vocabulary with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        inner, last = byte_letters(), [c + suffix for c in byte_letters()]
        self.inner = np.array([self.vocab.get(c, -1) for c in inner], np.int64)
        self.last = np.array([self.vocab.get(c, -1) for c in last], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.size = max(self.vocab.values()) + 1
        keys = self.left * self.size + self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        parts = spec["pre_tokenizer"]["pretokenizers"]
        self.word = regex.compile(parts[0]["pattern"]["Regex"])
        names = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.specials = regex.compile(f"({names})") if names else None
        self.space = regex.compile(r"\s+")
        self.path, self.library, self.known = path, None, set()
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}

    def words(self, text: str) -> list[str | int]:
        """Words in order; a special token of the text as its id."""
        if self.specials is None or not any(s in text for s in self.special):
            return self._plain_words(text)
        out: list[str | int] = []
        for part in self.specials.split(text):
            out += [self.special[part]] if part in self.special else self._plain_words(part)
        return out

    def _unknown(self, text: str) -> bool:
        """Whether a text has a code point that other tables may treat otherwise: one without
        a meaning in Python's, or a mark that the library orders in another way."""
        if text.isascii():
            return False
        fresh = set(text) - self.known
        if any(unicodedata.category(c) == "Cn" or self._strange_mark(c) for c in fresh):
            return True
        self.known |= fresh
        return False

    def _strange_mark(self, c: str) -> bool:
        if not unicodedata.combining(c):
            return False
        beside = [pair for mark in MARKS for pair in (c + mark, mark + c)]
        normal = self._library().normalizer.normalize_str
        return any(normal("a" + pair) != unicodedata.normalize("NFC", "a" + pair) for pair in beside)

    def _library(self):  # noqa: ANN202 - imported where it is needed
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def _split_by_library(self, text: str) -> list[str]:
        self._library()
        clean = self.library.normalizer.normalize_str(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(clean)
        return [bytes(self.byte_of[c] for c in letters).decode("utf-8") for letters, _ in found]

    def _plain_words(self, text: str) -> list[str]:
        if self._unknown(text):
            return self._split_by_library(text)
        clean = self.space.sub(" ", unicodedata.normalize("NFC", text))
        # Lower-casing goes letter by letter: a final sigma is not special.
        return self.word.findall(clean.replace("Σ", "σ").lower())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.by_key[at], NONE)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        known = symbol >= 0  # a symbol outside the vocabulary is left out
        symbol, owner = self._merged(symbol[known], owner[known])
        starts = np.searchsorted(owner, np.arange(len(raw) + 1))
        return [symbol[a:b] for a, b in itertools.pairwise(starts.tolist())]

    def _merged(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(symbol)
        if n < 2:
            return symbol, owner
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        borders = np.flatnonzero(owner[1:] != owner[:-1])
        after[borders], before[borders + 1] = -1, -1
        after[-1] = -1
        live = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[after[at]])
            found = rank != NONE
            at, rank = at[found], rank[found]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            for a, b in itertools.pairwise(cuts):
                r = int(rank[a])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[a:b])

        add(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[live[at] & (symbol[at] == self.left[r]) & (after[at] >= 0)]
            at = at[symbol[after[at]] == self.right[r]]
            if self.left[r] == self.right[r] and len(at) > 1:
                at = np.sort(at)  # of a run of equal symbols every other position
                follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
                place = np.arange(len(at))
                first = np.maximum.accumulate(np.where(follows, 0, place))
                at = at[(place - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at], live[gone] = self.made[r], False
            nexts = after[gone]
            after[at] = nexts
            inside = nexts >= 0
            before[nexts[inside]] = at[inside]
            earlier = before[at]
            add(np.unique(np.concatenate([at[inside], earlier[earlier >= 0]])))
        return symbol[live], owner[live]

    def decode(self, ids: list[int]) -> str:
        """Tokens as the vocabulary writes them, with a space between; specials are kept."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(many: list[str], code: Codec) -> Iterator[tuple[bytes, bytes]]:
    """Per text its ids as little-endian unsigned 32-bit integers, and its decoded text."""
    place: dict[str | int, int] = {}
    listed = []
    for text in many:
        own = code.words(text)
        listed.append(np.fromiter((place.setdefault(w, len(place)) for w in own), np.int32, len(own)))
    plain = [w for w in place if isinstance(w, str)]
    coded = dict(zip(plain, code.encode_words(plain))) if plain else {}
    raw, shown = [], []
    for word in place:
        ids = coded[word] if isinstance(word, str) else np.array([word])
        raw.append(ids.astype("<u4").tobytes())
        shown.append(code.decode(ids.tolist()).encode("utf-8"))
    for own in listed:
        at = own.tolist()
        yield (
            b"".join(map(raw.__getitem__, at)),
            b" ".join(d for d in map(shown.__getitem__, at) if d),
        )


def encode(
    docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, ids, decoded) of every row: ids as array, and the text they decode to.

    A null text counts as empty and has no ids. Repeated rows come back as often as
    they are; other columns are not looked at. Texts are encoded whole.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in sized(batches, 1, STRETCH):
            got = list(encode_documents(texts(batch.column(1)), code))
            ids = pa.array([np.frombuffer(g[0], "<u4") for g in got], pa.list_(pa.int64()))
            shown = pa.array([g[1].decode() for g in got], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, shown], ["key", "ids", "decoded"]
            )

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    schema = f"key {kind}, ids array<bigint>, decoded string"
    return plain.mapInArrow(run, schema).withColumnRenamed("key", key)


def digests(
    docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): as ``encode``, without the ids themselves."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in sized(batches, 1, STRETCH):
            got = [
                (len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest())
                for i, d in encode_documents(texts(batch.column(1)), code)
            ]
            counts, ids, shown = zip(*got)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.string()),
                    pa.array(shown, pa.string()),
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return plain.mapInArrow(run, schema).withColumnRenamed("key", key)
