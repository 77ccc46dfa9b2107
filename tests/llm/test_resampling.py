import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from orderlens.llm import resampling
from orderlens.llm.common import read
from orderlens.llm.queries import ORACLE_SQL, callables

FOLDER = "/root/testdata/sf0.01"


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_buckets(text):
    words = plain_words(text)
    out = []
    for i, word in enumerate(words):
        out.append(zlib.crc32(word.encode()) % 10000)
        if i + 1 < len(words):
            out.append(zlib.crc32(f"{word} {words[i + 1]}".encode()) % 10000)
    return out


def brute(rows, target, share=25, least_words=20, seed=7):
    """Sorted (doc_id, n_features, weight, score, rank)."""
    own = [plain_buckets(t) for _, t in rows]
    s, t = Counter(b for o in own for b in o), Counter(b for x in target for b in plain_buckets(x))
    many_s, many_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (many_s + 10000) / ((s[b] + 1) * (many_t + 10000))))
        for b in {*s, *t}
    }
    out, able = [], []
    for (key, text), o in zip(rows, own):
        weight = sum(gain[b] for b in o) // len(o) if o else 0
        name = f"{seed}:{'' if key is None else key}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(o), weight, score, None])
        if len(plain_words(text)) >= least_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = place
    return sorted(map(tuple, out), key=repr)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def target(spark, texts):
    return spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "item_id long, text string, key int")


def test_query_equals_brute_force_and_sql(spark):
    rows = [tuple(r) for r in read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    texts = [r.text for r in read(spark, FOLDER, "benchmark").collect()]
    got = callables()["op13_resampling"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    found = listed(got)
    assert found == brute(rows, texts)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS FROM '{FOLDER}/{name}.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op13_resampling"]).fetchall(), key=repr) == found


def random_text(draw, most=60):
    return "".join(draw.choice("abZ .9é\n日-\x7f") for _ in range(draw.randrange(most)))


def test_features_of_odd_texts_whole_and_in_stretches():
    draw = random.Random(1)
    texts = ["Hello World, foo", "", None, " \t", "one", "a-b c", "Ünï Çödé ÉA", "日本 語", "x" * 700 + " y", "É" * 600]
    texts += [random_text(draw) for _ in range(200)]
    values, edges = resampling.buckets(pa.array(texts))
    part, cut = resampling.buckets(pa.array(texts).slice(5, 40))
    for i, text in enumerate(texts):
        want = plain_buckets(text)
        assert values[edges[i] : edges[i + 1]].tolist() == want
        if 5 <= i < 45:
            assert part[cut[i - 5] : cut[i - 4]].tolist() == want
        for most in (1, 4, 11):
            assert resampling.long_buckets(text or "", most).tolist() == want


def test_crcs_of_every_length():
    draw = np.random.default_rng(2)
    many = [draw.bytes(n) for n in [*range(60), 511, 512, 513, 4000] * 3]
    assert resampling.crcs(pa.array(many, pa.large_binary())).tolist() == [zlib.crc32(b) for b in many]


def test_nulls_repeats_ties_and_long_texts(spark, frame, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 16)
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]

    def text(n):
        return " ".join(draw.choice(vocabulary) for _ in range(n))

    rows = [(i, text(draw.randrange(10, 40))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, text(30)), (None, None), (502, " ,;\n")]
    rows += [(7, rows[7][1])] * 100 + [(8, text(25))] * 3 + [(600 + i, rows[0][1]) for i in range(50)]
    rows += [(900, text(200_000))]
    goal = [text(30) for _ in range(5)] + [None, ""]
    got = resampling.resample(frame(rows, "weight"), target(spark, goal), share=60)
    assert listed(got) == brute(rows, goal, 60)
    cells = resampling.resample(frame(rows, "key"), target(spark, goal), share=60, seed=8, least_words=0)
    assert listed(cells) == brute(rows, goal, 60, 0, 8)


@pytest.mark.parametrize("goal", [[], ["a b c"]])
def test_empty_tables(spark, frame, goal):
    got = resampling.resample(frame([]), target(spark, goal))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and got.collect() == []
    rows = [(1, "a b c"), (2, None)]
    assert listed(resampling.resample(frame(rows), target(spark, goal))) == brute(rows, goal)


def test_drawn_documents_are_closer_to_the_target(spark, frame):
    draw = random.Random(6)
    near, far = ([f"{p}{i}" for i in range(200)] for p in "nf")
    rows = [(i, " ".join(draw.choice(near if i % 4 == 0 else far) for _ in range(60))) for i in range(400)]
    goal = [" ".join(draw.choice(near) for _ in range(60)) for _ in range(50)]
    docs = frame(rows)
    ranked = resampling.resample(docs, target(spark, goal))
    kept = resampling.drawn(docs, ranked)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == 100 and sum(i % 4 == 0 for i in ids) >= 50  # 25 without weights
