import hashlib
import random

import numpy as np
import pytest

from orderlens.llm import editprint
from orderlens.llm.common import read

FOLDER = "/root/testdata/sf0.001"


def plain_print(text):
    """One walk, step by step."""
    bits, symbol = editprint._shared()
    points = [(ord(c) * 2654435761 % 2**64 >> 13) % 255 for c in text]
    out, i, step = [], 0, 0
    while i < len(points):
        out.append(points[i])
        i += int(bits[step % editprint.PERIOD][points[i]])
        step += 1
    wanted, k = [], 0
    while len(wanted) == 0 or wanted[-1] < len(out):
        wanted += editprint._octave(k).tolist()
        k += 1
    return "".join(f"{symbol[out[j]]:x}" for j in wanted if j < len(out))


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghilmnoprstu") for _ in range(5)) for _ in range(n))


def test_walks_in_step_equal_single_walks():
    draw = random.Random(1)
    many = ["", "a", "aé日", "\n" * 50, *[words(draw, draw.randrange(1, 300)) for _ in range(30)]]
    assert editprint.fingerprints(many) == [plain_print(t) for t in many]
    assert editprint.fingerprints([]) == []


def test_likeness_follows_the_edits():
    draw = random.Random(2)
    text = words(draw, 800)
    marks, near = editprint.fingerprints([text]), []
    for edits in (0, 10, 60, 400):
        letters = list(text)
        for _ in range(edits):
            at = draw.randrange(len(letters))
            letters[at] = draw.choice(["", "x", letters[at] + "q"])
        near.append(editprint.likeness(marks[0], editprint.fingerprints(["".join(letters)])[0]))
    assert near[0] == 1 and near[1] > 0.6 and sorted(near, reverse=True) == near
    other = editprint.fingerprints([words(draw, 800)])[0]
    assert editprint.likeness(marks[0], other) < 0.3
    assert editprint.likeness("", "") == 1 and editprint.likeness("", marks[0]) == 0


def brute(rows):
    order = sorted(
        range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0))
    )
    out = {}
    for at, i in enumerate(order):
        after = rows[order[(at + 1) % len(order)]][1] or ""
        text = rows[i][1] or ""
        new = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        a, b, c = plain_print(text), plain_print(new), plain_print(after)
        out[rows[i][0]] = (
            len(text),
            hashlib.sha256(new.encode()).hexdigest(),
            a,
            b,
            pytest.approx(editprint.likeness(a, b)),
            pytest.approx(editprint.likeness(a, c)),
        )
    return out


def test_query_equals_brute_force(spark):
    from orderlens.llm.queries import callables

    docs = read(spark, FOLDER, "documents").select("doc_id", "text")
    small = [tuple(r) for r in docs.collect()]
    got = callables()["op5_edit_embedding"](spark, FOLDER).collect()
    assert len(got) == len(small)
    want = brute(small)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id]
    mean = np.mean([r.near_edited for r in got if r.n_chars > 300])
    assert mean > 0.6 and np.mean([r.near_next for r in got]) < 0.4


def test_edges_nulls_and_repeats(frame):
    rows = [(5, None), (4, ""), (None, "abc abc"), (2, "xyz " * 9000), (1, "hello there")]
    got = {r.doc_id: tuple(r)[1:] for r in editprint.describe(frame(rows)).collect()}
    assert got == brute(rows)
    twice = editprint.describe(frame([(1, "abcdef")] * 3 + [(0, "zz")], "part")).collect()
    assert len(twice) == 4 and sorted(r.near_next for r in twice)[2:] == [1, 1]
    assert editprint.describe(frame([(7, "abcdef")])).first().near_next == 1
    assert editprint.describe(frame([])).collect() == []
    assert editprint.describe(frame([(None, "a"), (None, "b")])).count() == 2


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_exact_distance():
    draw = random.Random(3)
    for _ in range(300):
        a = "".join(draw.choice("abc") for _ in range(draw.randrange(25)))
        b = "".join(draw.choice("abc") for _ in range(draw.randrange(25)))
        assert editprint.distance(a, b) == plain_distance(a, b)


def test_classes_of_near_texts(frame):
    draw = random.Random(4)
    base = [words(draw, 150) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        at = draw.randrange(len(t))
        rows += [(10 + i, t), (20 + i, t[:at] + "Q" + t[at + 3 :]), (30 + i, t + " tail")]
    rows += [(50, None), (51, ""), (None, base[0])]
    got = {r.doc_id: (r.class_id, r.links) for r in editprint.near_duplicates(frame(rows, "links")).collect()}
    for i in range(5):
        assert {got[k + i][0] for k in (0, 10, 20, 30)} == {i}
    assert got[None][0] == 0 and got[50] == got[51] == (50, 0)
    assert editprint.near_duplicates(frame([])).collect() == []


def test_distance_stops_beyond_a_limit():
    draw = random.Random(8)
    for _ in range(200):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(40))) for _ in range(2))
        real = editprint.distance(a, b)
        for most in (0, 3, 10, 50):
            got = editprint.distance(a, b, most)
            assert got == real if real <= most else got > most
