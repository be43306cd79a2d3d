"""Containers and mixes: exact invariants, held against small inputs with hot sources, nulls and ties."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cotejo.llm.mixing import mix, pivot, targets
from cotejo.llm.packing import fill_report, pack, window_shares
from cotejo.llm.tokens import VOCABULARY, _encoder, count_tokens, slices, with_token_counts


def sizes(spark, n, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["hot", "hot", "b", None]), rnd.choice([1, 5, 37, 80, 99, 100, 101, 250, 1000])) for i in range(n)]
    rows += [(n, "b", 0), (n + 1, "b", None), (None, "b", 42), (7, "b", 42), (7, "b", 42)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, tokens long")


@pytest.mark.parametrize("partition_items", [50, 100_000])
def test_pack_keeps_every_item_whole(spark, partition_items):
    rows, d = sizes(spark, 600, 1)
    caps = spark.createDataFrame([(1, 100), (2, 640), (3, 0)], "capacity_id int, capacity_tokens int")
    got = pack(d, caps, partition_items=partition_items, window=4)
    out = got.collect()
    for cid, cap in ((1, 100), (2, 640)):
        mine = [r for r in out if r["capacity_id"] == cid]
        load = Counter()
        pieces = defaultdict(list)
        for r in mine:
            load[r["container_id"]] += r["tokens"]
            pieces[r["item_id"]].append((r["start_token"], r["tokens"]))
        assert max(load.values()) <= cap
        want = Counter(t for i, _, t in rows if t and i != 7)
        assert Counter(sum(n for _, n in p) for i, p in pieces.items() if i not in (7,)) == want
        assert sum(n for _, n in pieces[7]) == sum(t for i, _, t in rows if i == 7 and t)
        for i, p in pieces.items():
            total = sum(n for _, n in p)
            if i not in (7, None):
                assert len(p) == -(-total // cap)  # cut only where larger than the container
                at = 0
                for start, n in sorted(p):
                    assert start == at
                    at += n
    unused = {r["capacity_id"]: r["unused_share"] for r in fill_report(got, caps).collect()}
    if partition_items > 600:
        assert unused[1] < 0.12 and unused[2] < 0.05
    assert {r["capacity_id"] for r in out} == {1, 2}


def test_windows_follow_the_proportions(spark):
    rows = [(i, "a" if i % 4 else "b", 10) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    out = pack(d, spark.createDataFrame([(1, 100)], "capacity_id int, capacity_tokens int"), partition_items=1000, window=8).collect()
    source = {i: s for i, s, _ in rows}
    part = defaultdict(list)
    for r in out:
        p, b = r["container_id"].split("-")
        part[p].append((int(b), source[r["item_id"]]))
    for seq in part.values():
        first = [s for b, s in seq if b < 40]
        assert abs(first.count("b") / len(first) - 0.25) < 0.06


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b ", " ", "  ", "\n", "\t", "'s", "1", "²", "é", "漢", "=", " (", " \x85", " \x1c", "x y"]), max_size=200), st.integers(1, 60))
def test_slices_never_change_the_count(parts, size):
    text = "".join(parts)
    assert "".join(slices(text, size)) == text
    assert count_tokens(text, size=size) == len(_encoder(VOCABULARY).encode_ordinary(text))


def test_window_report_and_repeated_rows(spark):
    rows = [(i, "a" if i % 4 else "b", 10) for i in range(4000)] + [(1, "a", 10)] * 4000  # half of all rows are one repeated row
    d, caps = spark.createDataFrame(rows, "doc_id long, source string, tokens long"), spark.createDataFrame([(1, 100)], "capacity_id int, capacity_tokens int")
    out = pack(d, caps, partition_items=1000, window=8)
    per = Counter(r["container_id"].split("-")[0] for r in out.collect())
    assert sum(per.values()) == 8000 and max(per.values()) < 1300  # the repeated row is spread over all partitions
    got = {r["source"]: r for r in window_shares(out, caps, window=8).collect()}
    assert got["a"]["target_share"] == got["a"]["share"] == 0.875 and got["a"]["mean_distance"] < 0.05
    assert window_shares(out.limit(0), caps).collect() == []


def test_pack_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, tokens long")
    assert pack(none, spark.createDataFrame([(1, 100)], "capacity_id int, capacity_tokens int")).collect() == []
    assert pack(none, spark.createDataFrame([], "capacity_id int, capacity_tokens int")).collect() == []


def test_targets_fill_up():
    got = targets([("a", 0.5, 1, 1000), ("b", 0.5, 2, 100), ("c", 0.0, 3, 10)], 1000)
    assert got == {"b": 200, "a": 800}
    assert targets([("a", 1.0, 1, 0)], 10) == {}


def test_pivot_keeps_mass_and_expectation():
    rnd = random.Random(3)
    size = [rnd.randint(1, 50) for _ in range(200)]
    hits = Counter()
    for k in range(400):
        prob = [0.3] * 200
        pivot(prob, size, random.Random(k))
        assert sum(0 < p < 1 for p in prob) <= 1
        assert abs(sum(p * s for p, s in zip(prob, size, strict=True)) - 0.3 * sum(size)) < 1e-6
        hits.update(i for i, p in enumerate(prob) if p > 0.5)
    assert all(0.15 < hits[i] / 400 < 0.45 for i in range(200))


@pytest.mark.parametrize("bucket", [3, 4096])
def test_mix_reaches_shares(spark, bucket):
    rnd = random.Random(9)
    rows = [(i, s, rnd.randint(1, 300)) for i, s in enumerate(["big"] * 700 + ["mid"] * 200 + ["tiny"] * 10 + ["none"] * 20)]
    rows += [(5000, "mid", None), (5001, None, 10), (5002, "mid", 0), (5003, "mid", 77), (5003, "mid", 77)]
    d = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    goal = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 3), ("tiny", 0.1, 2), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    copies, report = mix(d, goal, bucket=bucket)
    out = copies.collect()
    assert len(out) == len(rows)
    assert all(r["copies"] == 0 for r in out if r["source"] in (None, "none"))
    rep = {r["source"]: r for r in report.collect()}
    assert rep["tiny"]["most_copies"] == 2 and rep["tiny"]["mixed_tokens"] == 2 * rep["tiny"]["available_tokens"]
    total, most = sum(t or 0 for *_, t in rows), max(t or 0 for *_, t in rows)
    assert abs(sum(r["mixed_tokens"] for r in rep.values()) - total) <= 3 * most
    assert abs(rep["big"]["mixed_tokens"] / rep["mid"]["mixed_tokens"] - 1.25) < 0.02
    assert all(r["copies"] <= {"big": 1, "mid": 3, "tiny": 2}.get(r["source"], 0) for r in out)


def test_mix_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, tokens long")
    copies, report = mix(none, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert copies.collect() == [] and report.first()["mixed_tokens"] == 0


def test_token_counts(spark):
    assert count_tokens(None) == count_tokens("") == 0
    long = "palabra " * 60_000
    assert count_tokens(long) == len(_encoder(VOCABULARY).encode_ordinary(long))
    for run in (" " * 500_000, "=" * 500_000, "a" * 500_000 + "\n" * 300_000 + "b"):  # nowhere to cut
        assert count_tokens(run) > 0
    d = spark.createDataFrame([(1, "hola mundo", "s"), (2, None, None), (3, "", "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["tokens"] for r in with_token_counts(d, "text", ["doc_id", "source"]).collect()}
    assert got[1] == count_tokens("hola mundo") > 0 and got[2] == got[3] == 0
