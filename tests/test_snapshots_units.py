"""Snapshot differences and unit harmonisation."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cotejo.functions import units as units_fn
from cotejo.functions.units import price_phrase, stated, unit_phrase
from cotejo.operators.snapshots import canonical_product_url, pruning_report, snapshot_changes
from cotejo.operators import units as units_op
from cotejo.operators.units import harmonise_measures, harmonise_prices, pair_scales, snap, source_factors

SNAP = "g string, s string, k string, a string, b int, change string"


def diff(rows):
    by = {}
    for g, s, k, a, b, _ in rows:
        if None not in (g, s, k):
            by.setdefault(g, {}).setdefault(s, {}).setdefault(k, set()).add((a, b))
    out = set()
    for g, snaps in by.items():
        order = sorted(snaps)
        for old, new in zip(order, order[1:], strict=False):
            o, n = snaps[old], snaps[new]
            for k in o.keys() | n.keys():
                kind = "added" if k not in o else "removed" if k not in n else "changed" if o[k] != n[k] else None
                if kind:
                    out.add((g, k, new, kind))
    return out


@pytest.mark.parametrize(("leaf_rows", "range_rows", "fan_bits"), [(1, 1, 1), (2, 8, 4), (64, 512, 4)])
def test_snapshot_changes_match_brute_force(spark, leaf_rows, range_rows, fan_bits):
    rnd = random.Random(leaf_rows)
    rows = []
    for g in ("x", "y"):
        for s in ("2026-01-01", "2026-01-08", "2026-01-22", "2026-02-01"):
            for k in range(60):
                if rnd.random() < 0.9:
                    row = (g, s, f"u{k}", rnd.choice(["a", "a", "a", None]), rnd.choice([1, 1, 1, None]), "clash")
                    rows += [row] * rnd.choice([1, 1, 2])
    rows += [("x", "2026-01-08", "hot", "a", 1, "c")] * 300  # one key with very many copies
    rows += [(None, "2026-01-01", "u1", "a", 1, ""), ("x", None, "u1", "a", 1, ""), ("x", "2026-01-01", None, "a", 1, "")]
    got = snapshot_changes(spark.createDataFrame(rows, SNAP), "g", "s", "k", ["a", "b"], leaf_rows, range_rows, fan_bits)
    assert set(map(tuple, got.select("g", "k", "s", "change").collect())) == diff(rows)


def test_the_tree_spares_unchanged_rows(spark):
    rows = [("x", str(s), f"u{k}", "b" if s == 2 and k < 10 else "a", 1, "") for s in (1, 2) for k in range(1000)] + [("y", "1", "k", "a", 1, "")]
    got = pruning_report(spark.createDataFrame(rows, SNAP), "g", "s", "k", ["a", "b"]).collect()
    assert [(r["g"], r["s"], r["rows"]) for r in got] == [("x", "2", 2000)] and 20 <= got[0]["compared_rows"] <= 100


def test_null_and_value_differ_and_empty(spark):
    rows = [("x", "1", "k", None, 1, ""), ("x", "2", "k", "", 1, "")]
    assert [r["change"] for r in snapshot_changes(spark.createDataFrame(rows, SNAP), "g", "s", "k", ["a", "b"]).collect()] == ["changed"]
    assert snapshot_changes(spark.createDataFrame([], SNAP), "g", "s", "k", ["a", "b"]).collect() == []


def test_product_urls(spark):
    d = spark.createDataFrame([("HTTPS://WWW.X.cl/A/p/?u=1#z",), ("https://www.x.cl/A/p",), (" https://www.X.cl/A/p// ",), (None,)], "u string")
    assert [r[0] for r in d.select(canonical_product_url(F.col("u"))).collect()] == ["https://www.x.cl/A/p"] * 3 + [None]


UNITS = [
    ("kg", "kg", "1"), ("Kgs", "kgs", "1"), ("100gr", "gr", "100"), ("saco 30.000 g", "g", "30000"), ("Caja de 1,44 m²", "m2", "1.44"), ("caja (2.5 mt2)", "mt2", "2.5"),
    ("1/2 gal", "gal", "0.5"), ("metro lineal", "metro lineal", "1"), ("Tira de 2,4 mt", "mt", "2.4"), ("c/u", "c/u", "1"), ("10 m", "m", "10"), ("kg.", "kg", "1"), ("caja", "caja", "1"),
]


def test_unit_phrases(spark):
    d = spark.createDataFrame([(u[0],) for u in UNITS] + [("",), (None,), ("x" * 100_000,)], "u string")
    got = [tuple(r) for r in d.select(unit_phrase(F.col("u")).alias("p")).select("p.stem", "p.quantity").collect()]
    assert got[: len(UNITS)] == [(s, Decimal(q)) for _, s, q in UNITS]
    assert got[len(UNITS)][0] is None and got[len(UNITS) + 1][0] is None


def test_names(spark):
    d = spark.createDataFrame([("Clavo 2\" 5 KG - precio x kilo",), ("Látex 1/4 gal valor x 100 g",), ("Cable (precio por mt lineal)",), ("Tubo $/m²",), (None,)], "n string")
    assert [r[0] for r in d.select(price_phrase(F.col("n"))).collect()] == ["kilo", "100 g", "mt lineal", "m2", None]
    q = [{x["common"]: x["amount"] for x in (r[0] or [])} for r in d.select(stated(F.col("n"))).collect()]
    assert q[0]["kg"] == 5 and abs(q[1]["lt"] - Decimal("0.946352946")) < Decimal("1e-9") and q[4] == {}


def test_scales_snap_and_propagate(spark):
    rnd = random.Random(1)
    links = [("libra", "kg", float(x), 0.45359237 * x * rnd.uniform(0.97, 1.03)) for x in range(1, 40)]
    links += [("bolsa", "libra", float(x), 1.0 * x) for x in range(1, 20)] + [("raro", "kg", 1.0, 7.7)] * 10 + [("libra", "kg", None, 1.0), ("libra", "kg", 0.0, 1.0)]
    d = spark.createDataFrame(links, "source string, target string, x double, y double")
    s = {r["source"]: r for r in pair_scales(d).collect()}
    assert abs(s["libra"]["scale"] / 0.4536 - 1) < 0.03 and abs(s["libra"]["offset"]) < 0.5
    got = {r["source"]: r["est_factor"] for r in source_factors(d.withColumn("kind", F.lit(0)), d.select("source")).collect()}
    assert got["libra"] == Decimal("0.45359237") and "raro" not in got  # 7.7 is no known conversion
    snapped = spark.range(1).select(snap(F.lit(0.3), F.lit("m")).alias("a"), snap(F.lit(0.15), F.lit("m")).alias("b")).first()
    assert snapped["a"] == Decimal("0.3048") and snapped["b"] is None


LISTING = "silver_row_id string, name string, precio_normal long, precio_internet long, precio_oferta long, precio_tarjeta long, precio_unitario long, unidad_medida string, _factor string"


def test_prices_and_measures(spark):
    rows = [
        ("a", "Clavo 5 kg", 1000, None, None, None, 78, "lb", "x"), ("b", "Porcelanato", None, None, None, None, 18, "Caja de 1,44 m²", "x"), ("c", "Tubo valor x m", 1, 1, 1, 1, 1268, None, "x"),
        ("d", "Cemento", 1, None, None, None, 500, "pallet", "x"), ("e", "Cemento", 1, None, None, None, 0, "kg", "x"), ("f", None, None, None, None, None, 5, None, "x"), ("g", "Pintura", 1, None, None, None, 25, "docena", "x"),
    ]
    got = {(r["silver_row_id"], r["unidad_comun"], r["valor"]) for r in harmonise_prices(spark.createDataFrame(rows, LISTING)).collect()}
    assert got == {("a", "kg", 172), ("b", "m2", 13), ("c", "m", 1268), ("g", "un", 2)}  # 12.5 rounds up
    assert harmonise_prices(spark.createDataFrame([], LISTING)).collect() == []
    units = spark.createDataFrame([(1, "kilogramo"), (10, "galon"), (15, "pie")], "id_unidad int, nombre_unidad string")
    prods = [(1, "x", 1, Decimal("2.50")), (2, "Latex 1/4 gal", None, Decimal("3")), (3, "Cemento 30.000 g", 1, None), (4, "Llave", None, None), (5, "x", 15, Decimal("10.00")), (6, None, None, None)]
    d = spark.createDataFrame(prods, "id_producto int, nombre_producto string, id_unidad int, valor_medida decimal(10,2)")
    assert {tuple(r) for r in harmonise_measures(d, units).collect()} == {(1, "kg", 2500000), (2, "lt", 946353), (3, "kg", 30000000), (5, "m", 3048000)}


def test_spellings_outside_the_dictionary_are_resolved_by_links(spark):
    rnd = random.Random(3)
    rows, want = [], set()

    def offers(unit, per, text, n, wanted=None):
        for _ in range(n):
            amount, unit_price = rnd.choice([2, 4, 5, 10, 25]), rnd.randint(4000, 9000)
            price = round(unit_price / per * amount * rnd.uniform(0.94, 1.06))
            ident = f"{unit}{len(rows)}"
            rows.append((ident, f"Articulo {amount} {text}", price, round(price * 0.8), None, None, unit_price, unit, "x"))
            if wanted:
                want.add((ident, wanted, int(Decimal(unit_price) / Decimal(str(per)) + Decimal("0.5"))))

    offers("kgr", 1, "kg", 30, "kg")
    offers("onza", 0.028349523125, "kg", 30, "kg")
    offers("yarda", 0.9144, "m", 60, "m")
    offers("mtr", 1, "m", 60, "m")
    offers("kg", 1, "kg", 40, "kg")
    offers("pallet", 1, "kg", 40)  # steady, but the name vetoes it
    offers("cosa", 1, "kg", 20)  # as steady in every magnitude: no unit
    offers("cosa", 1, "m", 20)
    offers("cosa", 1, "lt", 20)
    offers("ktr", 1, "kg", 3)  # too few links
    got = {(r["silver_row_id"], r["unidad_comun"], r["valor"]) for r in harmonise_prices(spark.createDataFrame(rows, LISTING)).collect()}
    assert got == want
    units = spark.createDataFrame([(1, "Yarda"), (2, "caja")], "id_unidad int, nombre_unidad string")
    prods = [(i, f"Cable {i} m", u, Decimal(round(i / 0.9144, 2) if u == 1 else i)) for i in range(20, 30) for u in (1, 2)]
    d = spark.createDataFrame([(100 * p[2] + p[0], *p[1:]) for p in prods], "id_producto int, nombre_producto string, id_unidad int, valor_medida decimal(10,2)")
    got = {r["id_producto"]: (r["unidad_comun"], r["valor"]) for r in harmonise_measures(d, units).collect()}
    assert set(got) == {100 + i for i in range(20, 30)} and all(c == "m" and abs(v / 1e6 - (k - 100)) < 0.01 for k, (c, v) in got.items())


def test_factors_reach_over_other_spellings(spark):
    links = [("libra", "kg", float(x), 0.45359237 * x) for x in range(1, 20)] + [("lbr", "libra", float(x), 1.0 * x) for x in range(1, 20)]
    d = spark.createDataFrame(links, "source string, target string, x double, y double")
    got = {r["source"]: r["est_factor"] for r in source_factors(d.withColumn("kind", F.lit(0)), d.select("source")).collect()}
    assert got["lbr"] == Decimal("0.45359237")


def shop_listings(seed, units, n=60):
    """Listings of two shops for each article, with a unit price each and no contents in the name."""
    rnd, rows, same = random.Random(seed), [], []
    for i in range(n):
        per_kilo = rnd.randint(3000, 90000)
        for unit, factor in units:
            rows.append((f"{unit}{i}", "Articulo", None, None, None, None, round(per_kilo * factor * rnd.uniform(0.95, 1.05)), unit, "x"))
            same.append((f"e{i}", f"{unit}{i}"))
    return rows, same


def test_shared_articles_link_spellings_and_the_name_list_is_not_needed(spark, monkeypatch):
    rows, same = shop_listings(4, [("kg", 1), ("libra", 0.45359237), ("lbr", 0.45359237), ("caja", 1)])
    d, e = spark.createDataFrame(rows, LISTING), spark.createDataFrame(same + [("e1", None), (None, "kg1"), ("e1", "kg2")], "entity string, silver_row_id string")
    got = {r["silver_row_id"]: (r["unidad_comun"], r["valor"]) for r in harmonise_prices(d, e).collect()}
    by_price = {r[0]: r[6] for r in rows}
    want = {k: ("kg", int(Decimal(p) / Decimal("0.45359237" if k[0] == "l" else "1") + Decimal("0.5"))) for k, p in by_price.items() if not k.startswith("caja")}
    assert got == want
    for name in ("libra", "lb", "lbs", "libras"):
        monkeypatch.delitem(units_fn.NAMES, name)
    assert {r["silver_row_id"]: (r["unidad_comun"], r["valor"]) for r in harmonise_prices(d, e).collect()} == want


def test_without_estimates_linked_spellings_give_no_rows(spark, monkeypatch):
    rows, same = shop_listings(5, [("kg", 1), ("libra", 0.45359237)])
    rows += [("few", "Articulo", None, None, None, None, 500, "gramo", "x")]
    d, e = spark.createDataFrame(rows, LISTING), spark.createDataFrame(same, "entity string, silver_row_id string")
    monkeypatch.setattr(units_op, "snap", lambda *a, **k: F.lit(None).cast("decimal(24,12)"))
    got = {r["silver_row_id"] for r in harmonise_prices(d, e).collect()}
    assert got == {r[0] for r in rows if r[7] == "kg"} | {"few"}  # the name stands in only for spellings with too few links


def test_pack_contents_and_tile_sides(spark):
    d = spark.createDataFrame([("Sellador 600 ml bolsa 12 un",), ("Piso 30 x 60 cms",), ("Tubo 3 m",)], "n string")
    q = [{x["common"]: float(x["amount"]) for x in r[0]} for r in d.select(stated(F.col("n"))).collect()]
    assert q == [{"lt": 0.6, "un": 12.0}, {}, {"m": 3.0}]
