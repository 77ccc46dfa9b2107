import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from orderlens.llm import packing
from orderlens.llm.common import read

FOLDER = "/root/testdata/sf0.001"


def recursion(sizes, shares, window):
    """Deficit round-robin run window by window: (queue, position) in stream order."""
    left, carry, out, done = list(sizes), [0] * len(sizes), [], [0] * len(sizes)
    live = None
    while any(left):
        now = tuple(w if n else 0 for w, n in zip(shares, left))
        if not any(now):
            now = live if live and all(bool(a) == bool(b) for a, b in zip(live, left)) else tuple(left)
        if now != live:
            live, carry = now, [0] * len(sizes)
        for s, w in enumerate(live):
            carry[s] += window * w
            many = min(left[s], carry[s] // sum(live))
            carry[s] -= carry[s] // sum(live) * sum(live)
            out += [(s, done[s] + i) for i in range(many)]
            done[s] += many
            left[s] -= many
    return out


@pytest.mark.parametrize(
    "sizes,shares",
    [([50, 30, 20], [5, 3, 2]), ([1000, 1, 37], [1, 1, 1]), ([90, 10], [1, 9]), ([7], [7])],
)
@pytest.mark.parametrize("window", [16, 30])
def test_schedule_equals_the_recursion(sizes, shares, window):
    mixture = packing.Mixture(sizes, shares, window)
    got = {}
    for s, n in enumerate(sizes):
        step = max(1, n // 3)
        for a in range(0, n, step):
            for start, many, stream in mixture.place(s, a, min(n, a + step)):
                for i in range(many):
                    assert stream + i not in got
                    got[stream + i] = (s, start + i)
    assert [got[i] for i in range(sum(sizes))] == recursion(sizes, shares, window)


def check(rows, texts, length=packing.LENGTH):
    """Every id in exactly one piece, sequences gapless, only the last one short."""
    tokenizer = packing.load(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[key] += len(ids)
    got, places = Counter(), defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for s, spans in places.items():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at == length or (s == max(places) and at < length)
    assert sorted(places) == list(range(len(places)))


def test_query_packs_every_id_once(spark):
    from orderlens.llm.queries import callables

    rows = callables()["op4_packing"](spark, FOLDER).collect()
    texts = [tuple(r) for r in read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    check(rows, texts)
    tokenizer = packing.load(public_tokenizers.path(packing.VOCABULARY))
    ids = {
        k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, t in texts
    }
    for r in rows:
        cut = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(cut.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])


def test_every_window_has_the_mixture(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = packing.pack(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    total, windows = Counter(), defaultdict(Counter)
    for r in rows:
        total[r.source] += r.length
        windows[(r.sequence_id * 1024 + r.offset) // (4 * packing.WINDOW)][r.source] += r.length
    size, full = sum(total.values()), 4 * packing.WINDOW
    for w in list(windows)[:-1]:
        if sum(windows[w].values()) == full:
            for s, n in total.items():
                assert abs(windows[w][s] - full * n / size) < packing.WINDOW * n / size + 50


def test_edges_nulls_repeats(spark, frame):
    rows = [(1, None), (1, ""), (None, "a b c"), (2, "x " * 30000), (2, "x " * 30000)]
    check(packing.pack(frame(rows, "start")).collect(), rows)
    df = spark.createDataFrame(
        [(i, "word " * (i + 1), None if i % 3 else f"s{i % 5}") for i in range(60)],
        "doc_id long, text string, source string",
    )
    got = packing.pack(df, shares={"s0": 3, "s3": 1}, window=64, length=32).collect()
    check(got, [(i, "word " * (i + 1)) for i in range(60)], 32)


def test_empty_table(frame):
    got = packing.pack(frame([]))
    assert got.collect() == [] and got.columns[0] == "doc_id"


def test_ids_equal_the_library():
    path = public_tokenizers.path(packing.VOCABULARY)
    coder, tokenizer = packing.Coder(path, public_tokenizers.path(packing.RANKS)), packing.load(path)
    hard = ["", "It's <|endoftext|> I'LL", "a  b\n\n c \u00a0\u2003x", "12 345 \u0663", "\U0001f469\u200d\U0001f467 \u65e5\u672c"]
    hard += ["x" * 3000, " " * 3000, "ab " * 3000, "\n" * 500 + "z"]
    for text in hard:
        assert coder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
