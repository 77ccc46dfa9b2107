import zlib
from collections import Counter

import duckdb
import pytest

from orderlens.llm import sharding
from orderlens.llm.common import read
from orderlens.llm.queries import ORACLE_SQL, callables


def twin(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    return con.execute(ORACLE_SQL["op11_sharding"]).fetchall()


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def documents(spark, rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, copies int, digest string"
    return spark.createDataFrame([(i, t, "en", s, 1, 7, "x") for i, t, s in rows], kinds)


def check(rows, got, shards=24):
    """One row for each row, counts at most one apart, gapless slots, every source spread."""
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in got) == Counter(
        (i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t, _ in rows
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    every = Counter(s for _, _, s in rows)
    share = Counter((r.shard, r.source) for r in got)
    for s in range(shards):
        for source, n in every.items():
            fair = sizes[s] * n / len(rows)
            assert abs(share[s, source] - fair) <= 2 + len(every) * n / len(rows)


def test_query_equals_sql_on_a_small_folder(spark):
    folder = "/root/testdata/sf0.01"
    got = callables()["op11_sharding"](spark, folder)
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert listed(got) == sorted(twin(folder), key=repr)
    rows = [tuple(r) for r in read(spark, folder, "documents").select("doc_id", "text", "source").collect()]
    check(rows, got.collect())


@pytest.mark.parametrize("n", [0, 1, 5, 23, 24, 25, 200])
def test_small_tables(spark, n):
    rows = [(i, f"text {i}", "a" if i % 3 else "b") for i in range(n)]
    check(rows, sharding.assign(documents(spark, rows)).collect())


def test_nulls_repeats_long_texts_and_hot_rows(spark):
    rows = [(1, None, None), (None, "", "a"), (None, None, None), (1, None, None), (2, "é" * 10**6, "a")]
    rows += [(7, "same", "hot")] * 1500  # more copies than a block
    rows += [(100 + i, "copy", ["a", "b", ""][i % 3]) for i in range(1000)]
    got = sharding.assign(documents(spark, rows), block=64)
    check(rows, got.collect())
    cells = sharding.assign(documents(spark, rows), block=64, cell_rows=50)
    assert listed(cells) == listed(got)


def test_seed_decides_and_order_of_input_does_not(spark):
    rows = [(i, f"text {i}", "ab"[i % 2]) for i in range(300)]
    got = listed(sharding.assign(documents(spark, rows)))
    assert listed(sharding.assign(documents(spark, rows[::-1]).repartition(7))) == got
    assert listed(sharding.assign(documents(spark, rows), seed=12)) != got


def test_written_shards_hold_every_text_in_order(spark, tmp_path):
    rows = [(i, f"text {i}", "ab"[i % 2]) for i in range(100)] + [(3, "text 3", "b"), (4, None, None)]
    docs = documents(spark, rows)
    assigned = sharding.assign(docs, 4)
    sharding.write(docs, assigned, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in back) == Counter((i, t or "", s) for i, t, s in rows)
    places = {(r.shard, r.slot): (r.doc_id, r.text_crc32) for r in assigned.collect()}
    assert {(r.shard, r.slot): (r.doc_id, zlib.crc32(r.text.encode())) for r in back} == places


def test_main_path_is_native(spark):
    docs = documents(spark, [(1, "a", "s"), (2, "b", "t")])
    plan = sharding.assign(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
