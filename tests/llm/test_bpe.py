import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderlens.llm import bpe
from orderlens.llm.common import read

FOLDER = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def check(library, many):
    got = list(bpe.encode_documents([t or "" for t in many], bpe.codec(PATH)))
    for text, (raw, shown) in zip(many, got):
        ids, decoded = wanted(library, text)
        assert np.frombuffer(raw, "<u4").tolist() == ids, text
        assert shown.decode() == decoded, text


def test_query_equals_the_library(spark, library):
    from orderlens.llm.queries import callables

    docs = read(spark, FOLDER, "documents").select("doc_id", "text").collect()
    got = callables()["op3_bpe"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for r in docs:
        ids, decoded = wanted(library, r.text)
        assert by[r.doc_id].n_tokens == len(ids)
        raw = np.array(ids, "<u4").tobytes()
        assert by[r.doc_id].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert by[r.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_hard_texts(library):
    check(
        library,
        [
            "",
            None,
            " \n\t",
            "aaaaaaaaaaaaaaa " * 3,
            "It's I'LL we've 'd 's'S can't",
            "ΑΣ ΣΑΣ Σ İstanbul ǅ ﬁ Å é ẞ",
            "a<|endoftext|>b <|startoftext|> <|endoftext|",
            "日本語 テスト 👩‍👩‍👧 ½ ² 123 4٣",
            "x y z\u0085w\x1cq\x0bv​u",
            "z" * 20000 + " " + "lo" * 5000,
        ],
    )


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=60), max_size=5))
def test_any_text(library, many):
    check(library, many)


def test_every_code_point(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20000):
        many = [f"a{chr(c)}b 1{chr(c)}\u0301 {chr(c)}e\u0327{chr(c)}" for c in points[i : i + 20000]]
        ids = [e.ids for e in library.encode_batch(many, add_special_tokens=False)]
        got = bpe.encode_documents(many, bpe.codec(PATH))
        shown = library.decode_batch(ids, skip_special_tokens=False)
        for text, want, decoded, (raw, back) in zip(many, ids, shown, got):
            assert np.frombuffer(raw, "<u4").tolist() == want, text
            assert back.decode() == decoded, text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aeinrsth' .", max_size=200), max_size=5))
def test_letters_that_merge(library, many):
    check(library, many)


def test_edges_nulls_repeats_and_empty_table(frame):
    rows = [(1, None), (2, ""), (None, "the cat"), (3, "the cat"), (3, "the cat")]
    got = {r.doc_id: r for r in bpe.encode(frame(rows, "ids")).collect()}
    assert got[1].ids == got[2].ids == [] and got[1].decoded == ""
    assert got[3].decoded == "the</w> cat</w>" and got[None].ids == got[3].ids
    assert bpe.digests(frame(rows)).count() == 5
    assert bpe.digests(frame([])).collect() == []
