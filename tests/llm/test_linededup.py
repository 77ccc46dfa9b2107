import hashlib
import itertools
import random
from collections import Counter

from orderlens.llm import linededup
from orderlens.llm.common import read

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    """Brute force over all chunks in one dictionary."""
    seen, keeper = Counter(), {}
    for key, text in rows:
        for _, c in linededup.chunks(text or ""):
            if c:
                seen[c] += 1
                if key is not None:
                    keeper[c] = min(keeper.get(c, key), key)
    out = []
    for key, text in rows:
        pieces, done = [], set()
        for piece, c in linededup.chunks(text or ""):
            own = c is not None and (keeper.get(c) == key or c not in keeper) and c not in done
            pieces.append((piece, c is not None and seen[c] > 1 and not own))
            done.add(c)
        kept, cut = "", [0, 0]
        for gone, run in itertools.groupby(pieces, lambda p: p[1]):
            whole = "".join(p for p, _ in run)
            if gone and len(whole.encode()) >= 100:
                cut[0] += 1
                cut[1] += len(whole)
            else:
                kept += whole
        out.append((key, *cut, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    from orderlens.llm.queries import callables

    rows = [tuple(r) for r in read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    got = callables()["op2_line_dedup"](spark, FOLDER)
    assert collected(got) == plain(rows)
    assert sum(r.n_removed for r in got.collect()) > 0


def sentences(draw, n):
    return [
        " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(900)}" for _ in range(9)) + "."
        for _ in range(n)
    ]


def test_a_shifted_passage_is_caught_and_the_rest_stays(frame):
    draw = random.Random(2)
    passage = " ".join(sentences(draw, 14))
    rows, own = [], {}
    for i in range(6):
        before, after = "\n".join(sentences(draw, 3 + i)), " ".join(sentences(draw, 5))
        own[i] = (before, after)
        rows.append((i, f"{before} {passage} {after}"))
    got = {r.doc_id: r.text for r in linededup.remove_repeats(frame(rows)).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 6):
        assert len(got[i]) < len(rows[i][1]) - len(passage) / 3
        assert got[i].startswith(own[i][0].split("\n")[0]) and got[i].endswith(own[i][1][-40:])


def test_chunks_keep_every_character():
    text = "One. Two!  Three?\n\n Four\nfive 3.14 six. \n"
    for whole in (text, text * 50, "\n\n" + text, "x", " \n ", "é. ü.\n日本。"):
        assert "".join(w for w, _ in linededup.chunks(whole)) == whole
    assert linededup.chunks("") == []
    longer = "A line of some words. Another line of more words.\n" * 9
    assert {c for _, c in linededup.chunks(longer)} != {None}


def test_edges_nulls_repeats_and_clashing_columns(frame):
    draw = random.Random(4)
    body = "\n".join(sentences(draw, 30))
    rows = [(3, body), (3, body), (None, body), (9, body), (4, None), (5, ""), (6, "\n \n")]
    rows += [(7, body * 40)]
    df = frame(rows, extra="n_removed")
    got = linededup.remove_repeats(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[3] == [body, body] and by[4] == [None] and by[5] == [""] and by[6] == ["\n \n"]
    assert len(by[9][0]) < len(body) / 4 and len(by[None][0]) < len(body) / 4
    assert collected(linededup.report(df)) == plain(rows)


def test_empty_table(frame):
    assert linededup.remove_repeats(frame([])).collect() == []


def test_passages_of_one_line_and_inside_a_line_are_cut(frame):
    draw = random.Random(6)

    def words(n):
        return " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(90000)}" for _ in range(n))

    rows, planted = [], {}
    for i in range(60):
        passage = words(draw.randrange(50, 61))  # no line break, no end of a sentence
        glue = "\n" if i % 2 else " "
        for k in (0, 100):
            before, after = words(40 + k // 5 + i), words(30 + i)
            planted[i + k] = (before, passage, after)
            rows.append((i + k, before + glue + passage + glue + after))
    got = {r.doc_id: r for r in linededup.remove_repeats(frame(rows)).collect()}
    whole, gone = 0, []
    for i in range(60):
        assert got[i].text == rows[2 * i][1]
        before, passage, after = planted[100 + i]
        new = got[100 + i].text
        assert new.startswith(before) and new.endswith(after)  # only the passage is touched
        whole += len(passage)
        gone.append(got[100 + i].removed_chars)
    assert sum(g > 0 for g in gone) >= 54 and sum(gone) > 0.6 * whole


def test_phrases_in_common_stay(frame):
    draw = random.Random(9)
    rows = []
    for i in range(40):  # a phrase of eight words, a heading, in otherwise different texts
        own = " ".join(sentences(draw, 4))
        rows.append((i, f"Terms and conditions\n{own} as was agreed upon by all of them {own[::-1]}"))
    got = linededup.remove_repeats(frame(rows)).collect()
    assert all(r.n_removed == 0 for r in got)


def test_repeated_rows_bring_a_bounded_list(spark, frame):
    body = " ".join(sentences(random.Random(1), 20))
    rows = [(3, body)] * 500 + [(9, body)]
    got = collected(linededup.report(frame(rows)))
    assert got == plain(rows) and len({r for r in got if r[0] == 3}) == 1
    assert [r for r in got if r[0] == 9][0][2] > 0.8 * len(body)


def test_callers_columns_stay_without_counts(frame):
    df = frame([(1, "a b c")], extra="n_removed")
    assert linededup.remove_repeats(df, counts=False).collect() == df.collect()


def test_cutting_depends_on_nearby_bytes_only():
    draw = random.Random(7)
    many = [" ".join(sentences(draw, n)).encode() for n in range(12)]
    many += [b" \n ", b"", "\u65e5\u672c\u8a9e".encode() * 300, b"la " * 3000, b"x" * 5000]
    assert linededup.cuts_of(many) == [linededup.cuts_of([m])[0] for m in many]
    for m, cut in zip(many, linededup.cuts_of(many)):
        assert b"".join(m[a:c] for a, _, c in cut) == m
    a, b = (many[i] + b" " + many[11] + b" " + many[i + 1] for i in (4, 8))
    same = {d[x:y] for d in (many[11],) for x, y, _ in linededup.cuts_of([d])[0][2:-2] if y >= 0}
    assert same
    for d in (a, b):
        assert same <= {d[x:y] for x, y, _ in linededup.cuts_of([d])[0]}
