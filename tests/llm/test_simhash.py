import random

import numpy as np
import pytest
import xxhash

from orderlens.llm import simhash
from orderlens.llm.components import components
from orderlens.llm.common import read

FOLDER = "/root/testdata/sf0.001"


def plain_print(text, size):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, size, radius):
    prints = [plain_print(t, size) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    best = {}
    for (key, _), c in zip(rows, label):
        if key is not None:
            best[c] = min(best.get(c, key), key)
    return sorted(
        ((k, f"{p:016x}", best.get(c)) for (k, _), p, c in zip(rows, prints, label)), key=repr
    )


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    from orderlens.llm.queries import callables

    rows = [tuple(r) for r in read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    got = callables()["op9_simhash_near_dedup"](spark, FOLDER)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert collected(got) == plain_components(rows, 4, 4)


def test_edges_nulls_and_repeats(spark, frame):
    rows = [(1, None), (2, ""), (None, " \t"), (5, "a b"), (4, "A\nB"), (4, "A\nB"), (None, "x y z")]
    got = collected(simhash.near_duplicates(frame(rows)))
    assert got == plain_components(rows, 4, 4)


def test_empty_table(spark, frame):
    assert simhash.near_duplicates(frame([])).collect() == []


@pytest.mark.parametrize("hot", [8, 32768])
def test_chains_of_near_prints_in_cut_shards(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SHARD", 16)
    monkeypatch.setattr(simhash, "COMPARED", 64)
    draw = random.Random(3)
    prints = {draw.getrandbits(64) for _ in range(150)}
    for _ in range(250):  # chains and dense groups
        x = draw.choice(sorted(prints))
        for b in draw.sample(range(64), draw.randint(1, 6)):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    items = spark.createDataFrame([(f"{p:016x}",) for p in prints], "fingerprint string")
    links = simhash.links(items, 1, 4, 3).collect()
    assert all((int(r.a, 16) ^ int(r.b, 16)).bit_count() == r.distance <= 4 for r in links)
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    def groups(pairs):
        for p in prints:
            label[p] = p
        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            label[b] = a
        return {p: root(p) for p in prints}

    want = groups((a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4)
    assert groups((int(r.a, 16), int(r.b, 16)) for r in links) == want


def test_shard_links_span_at_every_distance():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, (1, 3), dtype=np.uint64)
    every = np.repeat(base, 60, axis=0)
    for row in every:
        for b in draw.integers(0, 192, 6):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    a, b, d = simhash.shard_links(every[:40], every[40:], 12)
    assert len(a) < 60
    for limit in range(1, 13):
        got, want = np.arange(60), np.arange(60)
        near = d <= limit
        got = simhash._merged(got, a[near], b[near])
        i, j = np.nonzero(np.bitwise_count(every[:, None] ^ every[None]).sum(axis=2) <= limit)
        own = (i < 40) | (j < 40)
        want = simhash._merged(want, i[own], j[own])
        assert (got == want).all()


def test_components_of_paths_stars_and_loops(spark):
    draw = random.Random(5)
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(200 + i, 200) for i in range(50)]
    extra = [(i, draw.randint(300, 340)) for i in range(300, 340)] + [(7, 7)]
    links = spark.createDataFrame(path + star + extra, "a long, b long")
    got = dict(tuple(r) for r in components(links).collect())
    label = {n: n for pair in path + star + extra for n in pair}
    for _ in range(100):
        for a, b in path + star + extra:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: c for n, c in label.items() if n in got}
    assert 7 not in got and got[139] == 100 and got[249] == 200
