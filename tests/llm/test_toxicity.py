import math
import random
import zlib

import pytest

from orderlens.llm import toxicity
from orderlens.llm.common import read

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels"))


def test_held_out_accuracy(spark, model):
    docs, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    got = toxicity.score(known, model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    bad = [r.score for r in held if r.toxic == 1]
    good = [r.score for r in held if r.toxic == 0]
    assert len(bad) > 50 and all(0 <= s <= 1 for s in bad + good)
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert wins > 0.85
    assert sum(s >= toxicity.REJECT for s in good) / len(good) < 0.02
    assert sum(s >= toxicity.REJECT for s in bad) / len(bad) > 0.5


def test_query_shape_and_folds(spark):
    from orderlens.llm.queries import callables

    got = callables()["op1_toxicity"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == read(spark, "/root/testdata/sf0.001", "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7)


def test_query_equals_brute_force(spark):
    """Sample, dictionaries and scores from whole tables in plain Python."""
    from orderlens.llm.queries import callables

    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in read(spark, folder, "documents").collect()}
    marks = {}
    for r in read(spark, folder, "labels").collect():
        if r.toxic is not None:
            marks[r.doc_id] = max(r.toxic, marks.get(r.doc_id, 0))
    known = {k: y for k, y in marks.items() if docs.get(k) is not None and zlib.crc32(str(k).encode()) % 3 != 1}
    sample = {y: [docs[k] for k in sorted(known) if known[k] == y and len(docs[k]) <= 20000] for y in (0, 1)}
    counts = {y: sum(v == y for v in known.values()) for y in (0, 1)}
    weight = {y: counts[y] / len(sample[y]) for y in (0, 1)}
    scale = (len(sample[0]) + len(sample[1])) / (counts[0] + counts[1])
    scorer = toxicity.fit(sample[1], sample[0], (weight[1] * scale, weight[0] * scale)).scorer()
    got = {r.doc_id: r.score for r in callables()["op1_toxicity"](spark, folder).collect()}
    assert set(got) == set(docs)
    for key, text in docs.items():
        cut = toxicity.windows(text or "")
        excess = sorted((len(scorer.by_ordinary.compress(w)) - len(scorer.by_toxic.compress(w)) for w in cut), reverse=True)
        top = [*excess, 0, 0, 0]
        high = sum(max(e - 2, 0) for e in excess)
        x = [1, top[0], sum(top[:2]), sum(top[:3]), math.log1p(high), high / len(cut), math.log(len(cut))]
        away = sum(a * b for a, b in zip(scorer.weights, x))
        assert got[key] == pytest.approx(1 / (1 + math.exp(-away)), abs=1e-9)


def test_dictionaries_hold_each_class_forms_whole():
    draw = random.Random(3)
    base = [f"w{draw.choice('abcdefghij')}{draw.choice('aeiou')}{draw.choice('klmnop')}er" for _ in range(300)]

    def text(marks):
        words = [draw.choice(base) for _ in range(60)]
        for at in range(0, 60, 20):
            words[at] = draw.choice(marks)
        return " ".join(words)

    bad = [text(["vileness", "grimly", "grimace"]) for _ in range(60)]
    good = [text(["sunshine", "daybreak"]) for _ in range(200)]
    toxic, ordinary = (d.decode().split() for d in toxicity._dictionaries(bad, good))
    assert {"vileness", "grimly", "grimace"} <= set(toxic) and not {"sunshine", "daybreak"} & set(toxic[:20])
    assert {"sunshine", "daybreak"} <= set(ordinary) and not {"vileness", "grimly"} & set(ordinary)
    assert toxicity.fitting(["aaa", "bb", "c"], 7) == ["bb", "aaa"] and toxicity.fitting([], 9) == []


def test_one_id_many_times_is_one_of_the_sample(spark, frame):
    rows = [(1, f"the same id {i}") for i in range(300)] + [(i, f"text number {i}") for i in range(2, 40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 40)] * 3, "doc_id long, quality int, toxic int")
    got = toxicity.classify(frame(rows), labels).collect()
    assert len(got) == len(rows)


def test_windows_cover_the_whole_text():
    text = "word " * 5000 + "x" * 1000 + "é" * 500
    cut = toxicity.windows(text)
    assert b"".join(cut).decode() == toxicity._plain(text)
    assert max(map(len, cut)) <= toxicity.WINDOW
    assert toxicity.windows("") == [b"  "]


def test_edges_nulls_and_repeats(frame, model):
    long = "stupid idiot loser " + "and the of to in " * 40000
    rows = [(1, None), (2, ""), (None, "the of and"), (3, long), (3, long), (4, "12 34 \n\n")]
    got = {(r.doc_id): r.score for r in toxicity.score(frame(rows, "score"), model).collect()}
    assert len(got) == 5 and all(0 <= s <= 1 for s in got.values())
    assert got[1] == got[2] < 0.5


def test_empty_tables(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.classify(frame([]), labels).collect() == []
    got = toxicity.classify(frame([(1, "a b"), (None, None)]), labels).collect()
    assert [r.predicted for r in got] == [0, 0]
