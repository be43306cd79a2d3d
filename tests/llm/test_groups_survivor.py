"""Hash-to-min groups and field-by-field survivors against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cotejo.llm.groups import hash_to_min, star_edges
from cotejo.llm.survivor import filled, newest, survivors, usable_brand, usable_image


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", [0, 1])
def test_random_graph_chain_and_hub(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"r{rnd.randint(0, 80):03}", f"r{rnd.randint(0, 80):03}") for _ in range(50)]
    chain = [f"c{i:04}" for i in range(200)]
    rnd.shuffle(chain)
    edges += list(zip(chain, chain[1:], strict=False))
    edges += [(f"h{i:04}", "h9999") for i in range(600)]  # a third of all rows at one hub
    edges += [(b, a) for a, b in edges[:40]] + edges[:40] + [("z", "z"), (None, "q"), ("q", None)]
    rnd.shuffle(edges)
    d = spark.createDataFrame(edges, "a string, b string").withColumn("v", F.lit(1)).withColumn("u", F.lit(2))  # clashing names
    assert {r["member"]: r["group_id"] for r in hash_to_min(d).collect()} == brute(edges)


def test_empty_and_unlinked(spark):
    assert hash_to_min(spark.createDataFrame([], "a string, b string")).collect() == []
    assert hash_to_min(spark.createDataFrame([("x", "x"), (None, None)], "a string, b string")).collect() == []


def test_star_edges_are_linear(spark):
    d = spark.createDataFrame([("s", f"m{i}") for i in range(50)] * 2 + [("t", "m1"), (None, "m2"), ("s", None)], "g string, m string")
    got = star_edges(d, "g", "m").collect()
    assert len(got) == 49 and {r["a"] for r in got} == {"m0"}


def test_usable_values(spark):
    rows = [("Genérico", "https://x.cl/a.jpg?w=1"), ("S/M", "http://cdn.x/assets/placeholder_400.jpg"), ("Brovanta", "/static/sin-foto.svg"), (" ", "data:image/gif;base64,R0"), (None, None), ("-", "https://img.x/no-image.png"), ("3M", "about:blank"), ("Sin  Marca", "null"), ("x", "a" * 100_000)]
    d = spark.createDataFrame(rows, "b string, i string").select(usable_brand(F.col("b")), usable_image(F.col("i")))
    got = [tuple(r) for r in d.collect()]
    assert [g[0] for g in got] == [False, False, True, False, False, False, True, False, True]
    assert [g[1] for g in got] == [True] + [False] * 8
    assert [r[0] for r in spark.createDataFrame([("a",), (" \t",), (None,)], "x string").select(filled(F.col("x"))).collect()] == [True, False, False]


def test_survivors_brute_force(spark):
    rnd = random.Random(4)
    rows = [(f"g{rnd.randint(0, 9)}", rnd.choice([None, *(f"i{k}" for k in range(30))]), rnd.choice([None, 1, 2, 3]), rnd.choice([None, 1, 2]), rnd.choice([True, False, None]), rnd.choice([True, False])) for _ in range(200)]
    rows = list({(g, i): (g, i, *x) for g, i, *x in rows}.values()) + [("only_null", None, 1, 1, True, True)]
    rows += rows[:10] + [("hot", "i1", 1, 1, True, True)] * 100
    d = spark.createDataFrame(rows, "g string, i string, age int, rank int, brand boolean, image boolean")
    got = {r["g"]: tuple(r)[1:] for r in survivors(d, "g", "i", [F.col("age"), F.col("rank")], {"b": F.col("brand"), "m": F.col("image")}, [F.col("brand"), F.col("image")]).collect()}
    far = lambda x: (x is None, x or 0)
    for g in {r[0] for r in rows}:
        mine = {r for r in rows if r[0] == g and r[1] is not None}
        pick = lambda ok, lead: min(((lead(r), far(r[2]), far(r[3]), r[1]) for r in mine if ok(r)), default=(0, 0, 0, ""))[3]
        want = (pick(lambda r: True, lambda r: -int(bool(r[4])) - int(r[5])), pick(lambda r: r[4], lambda r: 0), pick(lambda r: r[5], lambda r: 0))
        assert got[g] == want


def test_newest(spark):
    rows = [("a", None, "x"), ("a", "2026-01-02", "y"), ("a", "2026-01-01", "z"), ("b", None, None), (None, "2026-01-01", "q")]
    got = {tuple(r) for r in newest(spark.createDataFrame(rows, "id string, d string, f string"), "id", "d", ["f"]).collect()}
    assert got == {("a", "2026-01-02", "y"), ("b", None, None)}


def test_newest_takes_unreadable_dates_last(spark):
    rows = [("a", "sin fecha", "x"), ("a", "2026-01-02", "y"), ("a", None, "z"), ("b", "sin fecha", "x")]
    got = newest(spark.createDataFrame(rows, "i string, d string, v string"), "i", "d", ["v"])
    assert {tuple(r) for r in got.collect()} == {("a", "2026-01-02", "y"), ("b", None, "x")}
