"""Loads after the first equal a rebuild and leave the rest alone."""

import datetime as dt
import random
from pathlib import Path

import pytest

from orderlens.params import Params
from orderlens.plans.incremental import read_sequence, resequence, store_sequence
from orderlens.sources import swap

T = dt.datetime
START = T(2026, 1, 1)
KINDS = "order_id long, customer_id string, ordered_at_gst timestamp_ntz, day date, x int"


def orders(spark, rows):
    return spark.createDataFrame([(*r[:2], r[2], r[2].date(), r[3]) for r in rows], KINDS)


def made(draw, n, first, last):
    """Orders of customers with one heavy one and a missing name."""
    out = []
    for i in range(n):
        who = draw.choice(["hot", "hot", f"c{draw.randrange(30)}", None])
        when = START + dt.timedelta(days=draw.randrange(first, last), hours=draw.randrange(24))
        out.append((i, who, when, draw.randrange(3)))
    return out


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def listed(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot_rows", [None, 40])
def test_sequence_after_a_lookback_equals_a_rebuild(spark, tmp_path, hot_rows):
    p = Params(hot_rows=hot_rows, cell_rows=20)
    draw = random.Random(11)
    rows = made(draw, 300, 0, 30)
    path, again = str(tmp_path / "seq"), str(tmp_path / "again")
    store_sequence(orders(spark, rows), path, parts=8, params=p)
    cut, newest = dt.date(2026, 1, 26), dt.date(2026, 1, 31)
    old = [r for r in rows if not cut < r[2].date() <= newest]
    recent = [r for r in rows if r not in old]
    changed = recent[2:]  # two gone, one moved to another customer, one with another value
    changed[0] = (changed[0][0], "c29", *changed[0][2:])
    changed[1] = (*changed[1][:3], 9)
    changed += [(1000 + i, "hot", T(2026, 1, 29, i), 0) for i in range(5)]
    # Rows of other dates in the input are not this load's.
    given = orders(spark, changed + [(5000, "c1", T(2026, 1, 3), 0)])
    resequence(given, path, "day", cut, newest, parts=8, params=p)
    store_sequence(orders(spark, old + changed), again, parts=8, params=p)
    assert listed(read_sequence(given, path)) == listed(read_sequence(given, again))


def test_other_parts_keep_their_files(spark, tmp_path):
    rows = made(random.Random(2), 200, 0, 20)
    path = str(tmp_path / "seq")
    store_sequence(orders(spark, rows), path, parts=16)
    before = files(path)
    cut, newest = dt.date(2026, 1, 10), dt.date(2026, 1, 20)
    recent = [r for r in rows if cut < r[2].date() <= newest]
    assert resequence(orders(spark, recent), path, "day", cut, newest, parts=16) == []
    assert files(path) == before
    more = recent + [(900, "c3", T(2026, 1, 15), 0)]
    touched = resequence(orders(spark, more), path, "day", cut, newest, parts=16)
    assert len(touched) == 1
    kept = {f: t for f, t in before.items() if f"/{touched[0]}/" not in f}
    assert {f: t for f, t in files(path).items() if f"/{touched[0]}/" not in f} == kept
    assert read_sequence(orders(spark, rows), path).filter("order_id = 900").count() == 1


def test_a_customer_that_lost_all_orders_goes(spark, tmp_path):
    rows = [(1, "a", T(2026, 1, 5), 0), (2, "b", T(2026, 1, 6), 0), (3, "b", T(2026, 1, 1), 0)]
    path = str(tmp_path / "seq")
    store_sequence(orders(spark, rows), path, parts=64)
    resequence(orders(spark, []), path, "day", dt.date(2026, 1, 2), dt.date(2026, 1, 9), parts=64)
    left = read_sequence(orders(spark, []), path).collect()
    assert [(r.order_id, r.order_seq, r.customer_lifetime_orders) for r in left] == [(3, 1, 1)]


def test_a_load_that_dies_is_finished_by_the_next_reader(spark, tmp_path, monkeypatch):
    rows = [(i, f"c{i % 4}", START + dt.timedelta(days=i), 0) for i in range(12)]
    path = str(tmp_path / "seq")
    store_sequence(orders(spark, rows), path, parts=4)
    more = orders(spark, [(r[0], r[1], r[2], 5) for r in rows])
    move = swap._move

    def failing(session, old, new):
        if "/new/" in old:
            raise KeyboardInterrupt
        move(session, old, new)

    monkeypatch.setattr(swap, "_move", failing)
    with pytest.raises(KeyboardInterrupt):
        resequence(more, path, "day", dt.date(2025, 1, 1), dt.date(2027, 1, 1), parts=4)
    monkeypatch.setattr(swap, "_move", move)
    got = read_sequence(more, path).collect()
    assert len(got) == 12 and {r.x for r in got} == {5}
