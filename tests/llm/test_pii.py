import hashlib
import random
import re

import pytest

from orderlens.llm import pii
from orderlens.llm.common import read

FOLDER = "/root/testdata/sf0.01"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as the contract writes them."""
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) + sum(d[-1::-2])
        if 13 <= len(d) <= 19 and odd % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def test_query_equals_the_patterns(spark):
    from orderlens.llm.queries import callables

    docs = read(spark, FOLDER, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in callables()["op10_pii"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    found = 0
    for r in docs:
        want, row = plain(r.text or ""), got[r.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(k == s[0] for s in want) for k in range(4)
        ]
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(shown.split(",")) - {""} <= set(row.spans.split(","))
        assert want or not row.spans
        found += len(want)
    assert found > 20


def test_patterns_on_hard_strings():
    draw = random.Random(5)
    hard = ["a@b.c@d.e", "@@a@b..c", "1.2.3.4.5.6.7.8.9", "999.1.1.1.2.3.4", "+1+22 (3) 4444-555.66"]
    hard += ["4111 1111 1111 1111", "0" * 40, "x" * 60000 + "@", "1" * 60000, "é@b.co", "a@-.-"]
    letters = "ab1 2.3-4+5(6)7@8%_9é\n"
    hard += ["".join(draw.choice(letters) for _ in range(draw.randrange(80))) for _ in range(4000)]
    for text in hard:
        if len(text) < 1000:
            assert pii.base_spans(text) == plain(text), text
        else:
            pii.base_spans(text)


def test_skip_links_carry_a_label_through_the_document():
    texts = [f"call +1 (743) 555-{i:04d} or {i} now" for i in range(200)]
    texts += [f"write ann{i}@mail{i}.example.com about {1000000 + 7 * i}" for i in range(200)]
    model = pii.fit(texts)
    word = "lorem " * 50
    text = f"call +1 (743) 555-3824. {word} again (743) 555-3824, not (743) 555-9999. {word} 5553824"
    (base, every), (_, alone) = pii.spans([text, "again (743) 555-3824"], model)
    assert len(base) == 1 and alone == []
    added = [text[a:b] for k, a, b in every if (k, a, b) not in base]
    assert added == ["(743) 555-3824", "5553824"]
    assert pii.masked(text, every).count("[phone]") == 3 and "9999" in pii.masked(text, every)


def test_messages_equal_exact_marginals_on_a_tree():
    import itertools

    import numpy as np

    model = pii.fit([f"a +1 (743) 555-{i:04d} b 12 c 1.2.3.4" for i in range(50)])
    nodes = pii.units("x +1 (743) 555-3824 y 12 z 7777777 and 99", pii.base_spans("x +1 (743) 555-3824"))
    links = [(i, i + 1, i % 2) for i in range(len(nodes) - 1)]
    got = pii.marginals(model, nodes, links)
    own = np.array([pii._shape(u) for u in nodes]) @ model.weights
    own = np.maximum(own - own.max(axis=1, keepdims=True), pii.FLOOR)
    for i, u in enumerate(nodes):
        if u.label:
            own[i] = -30
            own[i, u.label] = 0
    want = np.zeros_like(got)
    for labels in itertools.product(range(5), repeat=len(nodes)):
        weight = np.exp(
            sum(own[i, l] for i, l in enumerate(labels))
            + sum(model.pairs[k, labels[i], labels[j]] for i, j, k in links)
        )
        for i, l in enumerate(labels):
            want[i, l] += weight
    want /= want.sum(axis=1, keepdims=True)
    assert got == pytest.approx(want, abs=0.02)


def test_edges_nulls_repeats_and_clashing_columns(frame):
    long = "call +1 (743) 555-3824 " + "word 12 " * 50000
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, long), (3, long)]
    got = pii.detect(frame(rows, "spans")).collect()
    assert len(got) == 5 and sorted(r.n_phone for r in got) == [0, 0, 0, 1, 1]
    out = pii.redact(frame(rows, "key"))
    assert out.columns[-1] == "key" and out.count() == 5
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[1] is None and by[2] == "" and by[None] == "[email]" and "[phone]" in by[3]
    assert pii.detect(frame([])).collect() == []
    assert pii.redact(frame([])).collect() == []
