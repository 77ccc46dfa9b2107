import zlib

import numpy as np

from orderlens.llm import language
from orderlens.llm.common import read


def test_held_out_accuracy(spark):
    from orderlens.llm.queries import callables

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in callables()["op8_language_id"](spark, folder).collect()}
    docs = read(spark, folder, "documents").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    right = []
    for r in docs:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= got[r.doc_id].score <= 1
        if got[r.doc_id].held_out:
            right.append(got[r.doc_id].lang_pred == r.lang)
    assert len(right) > 100 and np.mean(right) > 0.97


def plain_bundle(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = f" {' '.join(letters)} " if letters else ""
    out = np.zeros(language.DIMENSIONS)
    for i in range(len(line) - 2):
        a, b, c = (language.letter(ord(x)).astype(int) for x in line[i : i + 3])
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_bundles_and_prototypes_equal_brute_force(spark):
    many = ["", "12 !", "Ab", "the cat, the HAT", "Größe é ñandú", "日本 語", "x" * 500]
    many += [f"word{i} and more {'ab' * i}" for i in range(300)]
    got = np.concatenate(list(language.bundles(many)))
    assert np.allclose(got, [plain_bundle(t) for t in many], atol=1e-2)
    df = spark.createDataFrame([(t, "ab"[i % 2]) for i, t in enumerate(many)], "text string, lang string")
    model = language.train(df)
    for k, name in enumerate("ab"):
        total = sum(plain_bundle(t) for i, t in enumerate(many) if "ab"[i % 2] == name)
        assert np.allclose(model.prototypes[k], total / np.linalg.norm(total), atol=1e-5)


def test_edges_nulls_repeats_and_empty_tables(spark, frame):
    rows = [(1, None), (2, "12 34"), (None, "the of and"), (3, "a " * 40000), (3, "a " * 40000)]
    got = language.identify(frame(rows, "score")).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == "und" and by[1].score == 0
    assert by[3].lang_pred == "en"
    assert language.identify(frame([])).collect() == []
    bare = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identify(bare).first().lang_pred == "und"
