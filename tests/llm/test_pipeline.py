import random

import corpus_pipeline
import numpy as np

from orderlens.llm import pii, simhash, toxicity
from orderlens.llm.common import read

FOLDER = "/root/testdata/sf0.001"


def kept_ids(rows):
    """Brute force over all pairs: the smallest key of each component, null keys last."""
    from test_simhash import plain_print

    prints = np.array([plain_print(t, 4) for _, t in rows], np.uint64)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4).tolist():
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append((key is None, key))
    return sorted((min(g)[1] for g in groups.values()), key=repr)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


def test_near_copies_equal_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert ids(got) == kept_ids(rows)


def test_near_copies_of_a_large_group_edges_and_nulls(frame):
    draw = random.Random(8)
    base = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(150):  # each a near copy of the base, few of each other
        words = list(base)
        words[draw.randrange(400)] = f"x{draw.randrange(10**6)}"
        rows.append((i + 10, " ".join(words)))
    rows += [(5, " ".join(base)), (5, " ".join(base)), (6, None), (7, ""), (8, " \n"), (None, "a b")]
    rows += [(200 + i, " ".join(f"y{draw.randrange(10**6)}" for _ in range(80))) for i in range(40)]
    rows += [(300, "z " * 50000), (None, "z " * 49999)]
    got = simhash.keep_one(frame(rows, "row"))
    assert got.columns[-1] == "row"
    want = kept_ids(rows)
    assert ids(got) == want
    assert set(want) >= {5, 6, None, *range(200, 240), 300} and len(want) < 60
    assert simhash.keep_one(frame([], "label")).collect() == []


def test_stages_equal_brute_force(spark):
    """Each stage against plain Python over its whole input, which the one before made."""
    docs, seen = read(spark, FOLDER, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, FOLDER)
        if name == "toxicity":
            scorer = toxicity.train(docs, read(spark, FOLDER, "labels")).scorer()
            want = [(k, t) for k, t in before if scorer.score(t or "") < toxicity.REJECT]
        elif name == "line_dedup":
            from test_linededup import plain

            want = None
            kept = {r[0]: r[3] for r in plain(before)}
            import hashlib

            assert {
                r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest()
                for r in out.select("doc_id", "text").collect()
            } == kept
        elif name == "simhash_near_dedup":
            stay = set(kept_ids(before))
            want = [(k, t) for k, t in before if k in stay]
        elif name == "pii":
            model = pii.train(docs)
            want = [(k, t and pii.masked(t, e)) for (k, t), (_, e) in zip(before, pii.spans([t or "" for _, t in before], model))]
        else:
            from test_packing import check

            check(out.collect(), before)
            break
        assert out.columns == columns
        if want is not None:
            got = [tuple(r) for r in out.select("doc_id", "text").collect()]
            assert sorted(got) == sorted(want)
        seen.append(name)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert seen == ["toxicity", "line_dedup", "simhash_near_dedup", "pii"]


def test_run_packs_what_the_stages_keep(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    total = read(spark, FOLDER, "documents").count()
    assert 0.5 * total < len({r.doc_id for r in rows}) < total


def test_stages_on_an_empty_table(spark, frame):
    docs = frame([])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == [], name
