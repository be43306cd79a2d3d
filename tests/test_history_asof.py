"""Change histories and as-of attributes against brute force, with hot keys, ties, nulls and empty tables."""

import datetime as dt
import random

import pytest

from cotejo.operators.asof import attributes_at
from cotejo.operators.history import change_history, standing

SCHEMA = "p int, r int, t timestamp, id int, price long, ok boolean, valid_from string"
T0 = dt.datetime(2026, 1, 1)


def captures(n, seed, hot):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        p, r = (1, 1) if rnd.random() < hot else (rnd.randint(1, 4), rnd.randint(1, 3))
        t = T0 + dt.timedelta(hours=rnd.randint(0, n // 2))
        rows.append((p, r, t, i, rnd.choice([10, 20, None]), rnd.choice([True, False]), "clash"))
    rnd.shuffle(rows)
    return rows


def standing_rows(rows):
    best = {}
    for p, r, t, i, price, ok, _ in rows:
        if None in (p, r, t, i):
            continue
        k = (p, r, t)
        if k not in best or i > best[k][0]:
            best[k] = (i, price, ok)
    return best


def versions(rows):
    by = {}
    for (p, r, t), v in sorted(standing_rows(rows).items()):
        by.setdefault((p, r), []).append((t, *v))
    out = set()
    for (p, r), seq in by.items():
        starts = [x for k, x in enumerate(seq) if k == 0 or x[2:] != seq[k - 1][2:]]
        for k, x in enumerate(starts):
            nxt = starts[k + 1] if k + 1 < len(starts) else (None, None)
            out.add((p, r, x[0], nxt[0], x[1], nxt[1], x[2], x[3]))
    return out


@pytest.mark.parametrize(("chunk_bits", "segment_bits"), [(1, 1), (2, 2), (8, 11)])
def test_history_matches_brute_force(spark, chunk_bits, segment_bits):
    rows = captures(400, 3, hot=0.4)
    rows += rows[:20]  # repeated rows
    rows += [(None, 1, T0, 9001, 5, True, "x"), (1, None, T0, 9002, 5, True, "x"), (1, 1, None, 9003, 5, True, "x"), (1, 1, T0, None, 5, True, "x")]
    got = change_history(spark.createDataFrame(rows, SCHEMA), ["p", "r"], "t", "id", ["price", "ok"], chunk_bits, segment_bits)
    assert got.columns == ["p", "r", "valid_from", "valid_to", "first_id", "next_id", "price", "ok"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, versions(rows)))


def test_history_without_changes_crosses_segments(spark):
    rows = [(1, 1, T0 + dt.timedelta(hours=h), h, 10, True, "x") for h in range(100)] + [(1, 1, T0 + dt.timedelta(hours=100), 100, 20, True, "x")]
    got = change_history(spark.createDataFrame(rows, SCHEMA), ["p", "r"], "t", "id", ["price", "ok"], 1, 1).orderBy("first_id").collect()
    assert [(x["first_id"], x["next_id"]) for x in got] == [(0, 100), (100, None)]


def test_history_of_empty_table(spark):
    assert change_history(spark.createDataFrame([], SCHEMA), ["p", "r"], "t", "id", ["price", "ok"]).collect() == []


@pytest.mark.parametrize("segment_bits", [1, 3, 19])
def test_asof_matches_brute_force(spark, segment_bits):
    rows = captures(300, 5, hot=0.4)
    rnd = random.Random(6)
    events = [(i, *rnd.choice([(1, 1), (2, 2), (9, 9), (3, 1)]), T0 + dt.timedelta(hours=rnd.randint(-5, 160)), "x") for i in range(200)]
    events += [(500, 1, 1, None, "x"), (None, 1, 1, T0, "x"), (501, None, 1, T0, "x")]
    keep = standing(spark.createDataFrame(rows, SCHEMA), ["p", "r"], "t", "id", ["price", "ok"])
    ev = spark.createDataFrame(events, "event int, p int, r int, at timestamp, price string")
    got = attributes_at(keep, ev, ["p", "r"], "t", ["id", "price", "ok"], "event", "at", chunk_bits=2, segment_bits=segment_bits)
    best = standing_rows(rows)
    want = set()
    for e, p, r, at, _ in events:
        if None in (e, p, r, at):
            continue
        past = [(t, v) for (pp, rr, t), v in best.items() if (pp, rr) == (p, r) and t <= at]
        if past:
            want.add((e, *max(past)[1]))
    assert set(map(tuple, got.collect())) == want
    only = attributes_at(spark.createDataFrame(rows, SCHEMA), ev, ["p", "r"], "t", ["id"], "event", "at", "id", segment_bits=segment_bits)
    assert set(map(tuple, only.collect())) == {(e, i) for e, i, *_ in want}  # without standing(): ties leave the highest ident
    same = attributes_at(keep, ev, ["p", "r"], "t", ["id", "price", "ok"], "event", "at", "id", chunk_bits=2, segment_bits=segment_bits)
    assert set(map(tuple, same.collect())) == want


def test_asof_never_uses_later_values_and_handles_empty(spark):
    rows = [(1, 1, T0 + dt.timedelta(hours=1), 7, 10, True, "x")]
    keep = standing(spark.createDataFrame(rows, SCHEMA), ["p", "r"], "t", "id", ["price", "ok"])
    ev = spark.createDataFrame([(1, 1, 1, T0), (2, 1, 1, T0 + dt.timedelta(hours=1))], "event int, p int, r int, at timestamp")
    assert [tuple(x) for x in attributes_at(keep, ev, ["p", "r"], "t", ["id"], "event", "at").collect()] == [(2, 7)]
    none = standing(spark.createDataFrame([], SCHEMA), ["p", "r"], "t", "id", ["price", "ok"])
    assert attributes_at(none, ev, ["p", "r"], "t", ["id"], "event", "at").collect() == []
    assert attributes_at(keep, ev.limit(0), ["p", "r"], "t", ["id"], "event", "at").collect() == []
