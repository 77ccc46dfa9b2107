import gzip
import hashlib
import random

import duckdb
import pytest

from orderlens.llm import warc
from orderlens.llm.common import new_folder, read

FOLDER = "/root/testdata/sf0.01"


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_sql(spark):
    from orderlens.llm.queries import ORACLE_SQL, callables

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    want = con.sql(ORACLE_SQL["op6_warc"])
    got = callables()["op6_warc"](spark, FOLDER)
    assert got.columns == want.columns
    assert collected(got) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("squeeze", [True, False])
def test_edges_revisits_and_round_trip(spark, squeeze):
    big, odd = "é" * 600, "WARC/1.1\r\n\r\n\x00\x1f"
    rows = [(1, "a b", big), (9, "u", big), (5, None, big), (None, "u", big), (2, "u", None)]
    rows += [(3, "u", ""), (4, "u", odd), (7, "u", "x" * 3_000_000), (9, "u", big)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, uri int")
    folder = new_folder(spark, "test")
    warc.write(df, folder, gzip=squeeze)
    records, gaps = warc.read_archives(spark, folder)
    assert gaps.collect() == []
    got = {}
    for r in records.collect():
        got.setdefault(r.key, []).append(r)
    assert {k: r[0].record_type for k, r in got.items()} == {
        "1": "revisit", "9": "response", "5": "revisit", "": "revisit",
        "2": "response", "3": "response", "4": "response", "7": "response",
    }
    assert len(got["9"]) == 2 and got["1"][0].refers_to == "9"
    assert bytes(got["4"][0].payload) == odd.encode() and got["1"][0].payload_bytes == 1200
    assert got["1"][0].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert got["1"][0].uri == "a%20b" and got["7"][0].payload_bytes == 3_000_000


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).collect() == []


def archive(n, squeeze):
    out, starts = b"", []
    for i in range(n):
        body = random.Random(i).randbytes(300 + 40 * i)
        record = warc.build(i, f"u{i}", body, hashlib.sha1(body).hexdigest(), None)
        starts.append(len(out))
        out += warc.member(record) if squeeze else record
    return out, starts


@pytest.mark.parametrize("squeeze", [True, False])
def test_salvage_recovers_all_but_the_damaged(squeeze):
    data, starts = archive(12, squeeze)
    whole = warc.salvage(data + b"\0" * 7)
    assert len(whole.records) == 12 and whole.gaps == []
    draw = random.Random(7)
    for _ in range(150):
        bad = draw.randrange(12)
        end = [*starts, len(data)][bad + 1]
        at = draw.randrange(starts[bad], end)
        broken = bytearray(data)
        broken[at] ^= 1 << draw.randrange(8)
        got = warc.salvage(bytes(broken))
        keys = {r.key("WARC-Record-ID") for r in got.records}
        assert keys >= {str(i) for i in range(12) if i != bad}
        for start, stop, reason in got.gaps:
            assert starts[bad] <= start < stop <= end and reason


def test_salvage_of_cuts_inserts_and_shared_members():
    data, starts = archive(6, True)
    got = warc.salvage(data[: starts[3] + 50])
    assert [r.key("WARC-Record-ID") for r in got.records] == ["0", "1", "2"]
    assert [g[:2] for g in got.gaps] == [(starts[3], starts[3] + 50)]
    got = warc.salvage(data[starts[1] + 9 : starts[2]] + b"noise" + data[starts[2] :])
    assert len(got.records) == 4 and got.gaps[0][0] == 0
    plain, _ = archive(5, False)
    one = bytearray(gzip.compress(plain))
    assert len(warc.salvage(bytes(one)).records) == 5
    one[-5] ^= 255  # the checksum of the whole member
    got = warc.salvage(bytes(one) + data)
    assert len(got.records) == 11 and len(got.gaps) == 1
    assert warc.salvage(b"").records == [] and warc.salvage(b"nothing").gaps[0][:2] == (0, 7)


def test_records_behind_a_bad_one_in_a_shared_member():
    made = [warc.build(i, "u", b"payload %d " % i * 50, "", None) for i in range(6)]
    broken = bytearray(b"".join(made))
    broken[len(made[0]) + made[1].index(b"payload")] ^= 1
    for data in (bytes(broken), warc.member(bytes(broken))):
        read = warc.salvage(data)
        assert [r.key("WARC-Record-ID") for r in read.records] == ["0", "2", "3", "4", "5"]
        assert len(read.gaps) == 1 and "block digest" in read.gaps[0][2]
    packed = warc.member(bytes(broken)) + warc.member(made[0])
    read = warc.salvage(packed)
    assert len(read.records) == 6 and f"bytes {len(made[0])} to {len(made[0] + made[1])}" in read.gaps[0][2]


def test_digests_in_base32():
    import base64
    import hashlib

    record = warc.build(1, "u", b"some payload", "", None)
    block = record.partition(b"\r\n\r\n")[2][:-4]
    named = base64.b32encode(hashlib.sha1(block).digest())
    other = record.replace(hashlib.sha1(block).hexdigest().encode(), named)
    assert len(warc.salvage(other).records) == 1 and not warc.salvage(other).gaps
    wrong = record.replace(hashlib.sha1(block).hexdigest().encode(), named[:-1] + b"A")
    assert warc.salvage(wrong).gaps[0][2] == "block digest"
    assert warc.same_digest("md5:x", b"") and not warc.same_digest("SHA1:x", b"")
