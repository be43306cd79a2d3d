"""Catalogue functions, matching and loading operators; every SQL statement against its query."""

import os
import sys

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from cotejo.functions import catalog as fn
from cotejo.operators import matching, store

SF = "/root/testdata/sf0.001"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("given_", "want"), [("Taladro Percutor 13 mm &amp; Batería 18V", "taladro percutor bateria 18v"), ("Cañería de PVC 110mm x 3 m", "caneria pvc 110mm"), ("  Kit  ", "")])
def test_normalize_name(spark, given_, want):
    assert one(spark, fn.normalize_name(F.lit(given_))) == want


@pytest.mark.parametrize(("given_", "want"), [("Black & Decker", "BLACK & DECKER"), ("  ", "SIN MARCA"), ("sinmarca", "SIN MARCA"), (None, "SIN MARCA"), ("Bosch", "BOSCH")])
def test_normalize_brand(spark, given_, want):
    assert one(spark, fn.normalize_brand(F.lit(given_).cast("string"))) == want


@pytest.mark.parametrize(("given_", "want"), [("m²", "m2"), ("G", "gr"), ("caja", None)])
def test_normalize_unit(spark, given_, want):
    assert one(spark, fn.normalize_unit(F.lit(given_))) == want


def test_small_functions(spark):
    assert one(spark, fn.spec_text(fn.numeric_specs(F.lit("Taladro 13 mm 18V")))) == "diametro=13mm;voltaje=18V"
    assert one(spark, fn.parse_price(F.lit("$ 1.234,50"))) == 123450
    assert tuple(one(spark, fn.unit_price_from_text(F.lit("$ 1.990 por m²")))) == (1990, "m2")
    assert one(spark, fn.effective_price(F.lit(0), F.lit(None).cast("long"), F.lit(900), F.lit(1000))) == 900
    assert one(spark, fn.effective_price(F.lit(0), F.lit(None).cast("long"))) is None
    assert one(spark, fn.canonical_url(F.lit("https://x.cl/a/p/p/p?u=1#z"))) == "https://x.cl/a/p"
    assert one(spark, fn.short_id(F.lit("easy"), F.lit("12345"), F.lit("https://www.easy.cl/a/p"))) == "1e03b9f5099671a7"
    assert one(spark, fn.bag_difference(F.array(F.lit(1), F.lit(1), F.lit(2)), F.array(F.lit(1)))) == [1, 2]
    assert one(spark, fn.untracked_url(F.lit("https://x.cl/a?utm_x=1&b=2&ref=3"))) == "https://x.cl/a?b=2"
    assert one(spark, fn.category_from_url(F.lit("https://x.cl/s/lista/cat3035/Batidoras-Manuales"))) == "batidoras manuales"
    assert one(spark, fn.decision_label(F.lit("no match"))) == "NO_MATCH"


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("cemento saco polpaico", "cemento polpaico especial", 86), ("taladro percutor bateria 18v", "taladro percutor 18v", 100), ("disco corte metal", "disco corte madera", 86), ("pintura latex blanco", "esmalte sintetico negro", 37), ("", "x", 0)],
)
def test_token_set(a, b, want):
    assert matching.token_set_ratio(a, b) == want


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=90), st.text("abc ", max_size=90))
def test_lcs(a, b):
    assert matching._lcs(a, b) == slow_lcs(a, b)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (9, 8), (5, 5), (None, 3)] + [(i, i + 1) for i in range(20, 60)], "a int, b int")
    got = {r["id"]: r["component"] for r in matching.components(e, "a", "b").collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and got[9] == 8 and 5 not in got and {got[i] for i in range(20, 61)} == {20}


def test_candidate_pairs_brute_force(spark):
    rows = [(1, "a", "disco corte metal", "X", None), (2, "b", "disco metal", "X", None), (3, "b", "disco", "SIN MARCA", "kg"), (4, "a", "clavo", "SIN MARCA", "kg"), (5, "b", "clavo disco", "Y", "m"), (6, "a", "disco", "X", "m"), (7, "c", None, "X", None)]
    d = spark.createDataFrame(rows, "id int, store string, name string, brand string, unit string")
    got = {tuple(r) for r in matching.candidate_pairs(d).collect()}
    want = set()
    for l in rows:
        for r in rows:
            ok_b = l[3] == r[3] or "SIN MARCA" in (l[3], r[3])
            ok_u = not l[4] or not r[4] or l[4] == r[4]
            if l[1] < r[1] and ok_b and ok_u and set((l[2] or "").split()) & set((r[2] or "").split()):
                want.add((l[0], r[0]))
    assert got == want


def test_equal_rows_are_paired_as_one(spark, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 3)
    monkeypatch.setattr(matching, "TASK_PAIRS", 10)
    rows = spark.range(90).selectExpr("id", "concat('s', id % 3) as store", "concat('disco ', if(id % 2 = 0, 'corte', 'metal')) as name", "'X' as brand", "cast(null as string) as unit")
    c = matching.classes(rows)
    assert (c.groups.count(), c.nodes.count(), matching.kind_pairs(c.kinds).count()) == (2, 6, 4)
    assert c.members.count() > 6
    got = [tuple(r) for r in matching.candidate_pairs(rows).collect()]
    assert len(got) == 3 * 30 * 30 and set(got) == {(a, b) for a in range(90) for b in range(90) if a % 3 < b % 3}


def test_scores_of_classes_are_those_of_their_rows(spark, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 2)
    monkeypatch.setattr(matching, "TASK_PAIRS", 5)
    rows = [(i, f"s{i % 3}", ("disco corte", "disco metal")[i % 2], ("X", "SIN MARCA")[i // 20], (None, "kg")[i % 5 == 0], {"d": f"{3 + i % 4}mm"} if i % 7 else {}, ["missing_sku"] * (i % 11 == 0), (100.0, 350.0, None, 0.0)[i % 4]) for i in range(40)]
    d = spark.createDataFrame(rows, "id int, store string, name string, brand string, unit string, specs map<string,string>, flags array<string>, price double")
    assert matching.scorable(d).groups.count() < 40
    got = {(r["left_id"], r["right_id"]): (r["penalty"], r["score"], r["conflicts"], r["tier"]) for r in matching.scored_pairs(d).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[1] < b[1] and (a[3] == b[3] or "SIN MARCA" in (a[3], b[3])) and (not a[4] or not b[4] or a[4] == b[4]):
                ts, lev = matching.token_set_ratio(a[2], b[2]), 0 if a[2] == b[2] else 4
                brand = {2: 40, 1: 25, 0: 100}[(a[3] == "SIN MARCA") + (b[3] == "SIN MARCA")]
                both = a[5] and b[5]
                x, y = (int(v[5].get("d", "0mm")[:-2]) for v in (a, b))
                clash = both and abs(x - y) / max(x, y) > 0.1
                numeric = 100 if both and x == y else 55 if a[5] or b[5] else 70
                unit = 100 if a[4] and a[4] == b[4] else 60 if a[4] or b[4] else 70
                penalty = 3 * (len(a[6]) + len(b[6]))
                outlier = bool(a[7] and b[7] and max(a[7], b[7]) / min(a[7], b[7]) > 3)
                score = max(round((ts * 65 + brand * 20 + numeric * 10 + unit * 5) / 100) - penalty - 15 * outlier, 0)
                tier = "rejected" if clash else "confident" if score >= 90 and ts >= 90 and brand == 100 else "review" if score >= 78 else "rejected"
                want[a[0], b[0]] = (penalty, score, "d" if clash else "", tier)
    assert got == want and any(v[3] == "confident" for v in want.values())


def test_scored_pairs_move_cells_of_kinds_and_no_pairs_of_classes(spark, monkeypatch):
    monkeypatch.setattr(matching, "CELL", 70, raising=False)
    monkeypatch.setattr(matching, "TASK_PAIRS", 10_000)
    rows = spark.range(600).selectExpr(
        "id", "concat('s', id % 2) as store", "'disco corte' as name", "'X' as brand", "cast(null as string) as unit", "map('d', concat(1 + id div 2, 'mm')) as specs", "cast(array() as array<string>) as flags", "900.0 as price"
    )
    sc, counts = spark.sparkContext._jsc.sc(), []
    real = matching.cut
    monkeypatch.setattr(matching, "cut", lambda d, *a: counts.append((x := real(d, *a)).df.count()) or x)

    def moved() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        e = sc.statusStore().executorList(True)
        return sum(e.apply(i).totalShuffleWrite() for i in range(e.size()))

    before = moved()
    got = matching.scored_pairs(rows).groupBy("tier", "numeric_score").count().collect()
    near = sum(abs(a - b) / max(a, b) <= 0.1 for a in range(1, 301) for b in range(1, 301) if a != b)
    assert {tuple(r) for r in got} == {("confident", 100, 300), ("confident", 55, near), ("rejected", 55, 90_000 - 300 - near)}
    assert max(counts) <= 600 and moved() - before < 1_000_000


MANY = 60_000  # equal rows: their pairs can be counted or ranked, but not formed


def many(spark):
    """Equal rows of two stores: 900 million pairs of one score."""
    return spark.range(MANY).selectExpr(
        "id", "concat('s', id % 2) as store", "'disco corte' as name", "'X' as brand", "cast(null as string) as unit", "map('d', '3mm') as specs", "cast(array() as array<string>) as flags", "900.0 + id % 7 as price"
    )


def test_pairs_by_store_are_counted(spark):
    assert [tuple(r) for r in matching.store_counts(many(spark)).collect()] == [("s0", "s1", (MANY // 2) ** 2)]


def test_tiers_are_counted(spark):
    assert [tuple(r) for r in matching.tier_counts(many(spark)).collect()] == [("confident", False, (MANY // 2) ** 2, 98, 98)]


def test_best_pairs_for_review_are_ranked(spark):
    rows = many(spark).withColumn("flags", F.array(F.lit("missing_brand")))
    got = [(r["left_id"], r["right_id"], r["score"], r["tier"]) for r in matching.review_pairs(rows, 70_000).filter("left_id < 5").collect()]
    assert len(got) == 70_000 and {g[2:] for g in got} == {(88, "review")}
    best = [(r["left_id"], r["right_id"]) for r in matching.review_pairs(rows, 4).collect()]
    assert best == [(0, 1), (0, 3), (0, 5), (0, 7)]


def test_golden_records_of_many_equal_rows(spark):
    got = matching.golden_records(many(spark)).collect()
    assert [(r["component"], r["members"], r["stores"], r["pairs"], r["avg_score"], r["price_reference"]) for r in got] == [(0, MANY, 2, (MANY // 2) ** 2, 98.0, 900.0)]


def test_best_previews_are_ranked(spark):
    assert [tuple(r) for r in matching.best_previews(many(spark), 60, 30, 3).collect()] == [(0, 1, 100), (0, 3, 100), (0, 5, 100)]


def test_previews_are_scored_by_classes(spark):
    rows = many(spark).filter("id < 60")
    assert matching.class_previews(matching.classes(rows)).count() == 1
    got = matching.preview_pairs(rows)
    assert got.count() == 900 and [tuple(r) for r in got.select("token_score", "distance", "score").distinct().collect()] == [(100, 0, 100)]


def test_upsert_and_new_ids(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, o int"), spark.createDataFrame([(2, "c", 5), (3, None, 1)], "k int, v string, o int")
    assert {(r["k"], r["v"]) for r in store.upsert(old, new, ["k"], "o").collect()} == {(1, "a"), (2, "c"), (3, None)}
    dim = spark.createDataFrame([(1, "x"), (7, "y")], "i int, n string")
    got = store.get_or_create(spark.createDataFrame([("b",), ("x",), ("a",), (None,), ("a",)], "n string"), dim, "n", "i")
    assert {tuple(r) for r in got.collect()} == {(1, "x"), (7, "y"), (8, "a"), (9, "b")}


def rows_of(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in df.astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_agrees(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_row_ids_by_every_step_of_the_cascade(spark):
    rows = [("r1", "Easy", "k1", "https://x.cl/a/p"), ("r2", "easy", "k1", "https://x.cl/b"), ("r3", "easy", "k3", "https://x.cl/c"), ("r4", "easy", "", "https://x.cl/d")]
    d = spark.createDataFrame(rows, "silver_row_id string, store string, sku_store string, product_url string")
    sides = [
        ("r1", None, None, None, "r1"), ("?", "EASY ", "k1", "HTTPS://X.cl/b/?q=1", "r2"), ("?", "easy", "k1", "https://x.cl/a/p/p", "r1"), ("?", "easy", "k1", "https://x.cl/z", None),
        (None, "easy", " k3", "https://x.cl/z", "r3"), ("", "easy", "no", "https://x.cl/d/", "r4"), ("", "otra", "k3", "https://x.cl/d", None), (None, None, None, None, None),
    ]
    got = matching.resolve_row_ids(spark.createDataFrame([s[:4] for s in sides], "rid string, store string, sku string, url string"), d)
    assert {tuple(r) for r in got.collect()} == set(sides)


def test_components_that_need_more_rounds_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "l int, r int")
    with pytest.raises(RuntimeError, match="not stable"):
        matching.components(chain, "l", "r", max_rounds=2)
    assert {r["component"] for r in matching.components(chain, "l", "r").collect()} == {0}
