"""Silver rows, entities and serving operators on odd tables: nulls, ties, repeats, empty ones."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cotejo.operators import entities, serving, silver, store
from cotejo.sources.sinks import without_noise, write_gold

T = dt.datetime(2026, 1, 1)
BRONZE = (
    "store string, name string, brand string, sku_store string, product_url string, precio_normal long, precio_internet long, precio_oferta long, precio_tarjeta long, precio_unitario long, unidad_medida string, "
    "precio_unitario_fuente string, image_url string"
)


def test_silver_rows_of_odd_listings(spark):
    rows = [("a", " Taladro  18V &amp; más ", None, None, "https://x.cl/s/lista/cat1/Taladros/p/p?u=1", 0, 900, None, None, 5, "caja", None, None), ("a", None, None, None, None, None, None, None, None, None, None, None, None)]
    hints = spark.createDataFrame([("a", "https://x.cl/s/lista/cat1/Taladros/p", "https://x.cl/s/lista/Ofertas")], "store string, product_url string, category_url string")
    d = silver.silver_rows(spark.createDataFrame(rows, BRONZE), hints, "now")
    assert len(d.columns) == 24
    got = {r["product_url"]: r for r in d.collect()}
    one, none = got["https://x.cl/s/lista/cat1/Taladros/p"], got[""]
    assert (one["effective_price"], one["category_normalized"], one["category_source"], one["numeric_specs"]) == (900, "ofertas", "sidecar", {"voltaje": "18V"})
    assert one["quality_flags"] == ["missing_brand", "missing_sku", "unknown_unit"] and none["category_source"] == "empty" and "empty_name_normalized" in none["quality_flags"]
    assert silver.checked_silver(d.filter("product_url <> ''"), ["a"], strict=True).count() == 1
    with pytest.raises(Exception, match="missing required fields"):
        silver.checked_silver(d).collect()
    with pytest.raises(ValueError, match="zz"):
        silver.checked_silver(d, ["a", "zz"], strict=True)
    assert silver.silver_metrics(d).first()["total_rows"] == 2 and silver.silver_rows(spark.createDataFrame([], BRONZE), hints, "now").collect() == []


ROW = "silver_row_id string, store string, name_original string, name_normalized string, brand_original string, brand_normalized string, sku_store string, product_url string, effective_price long, unidad_medida string, image_url string, quality_flags array<string>, category_normalized string"


def test_golden_entities(spark):
    def row(i, s, name, price, image, flags):
        return (i, s, name, name, "B", "B", "", "", price, None, image, flags, "")

    rows = spark.createDataFrame([row("1", "a", "corto", 0, None, []), row("2", "b", "mas largo", 50, "", []), row("3", "b", "el mas largo", 40, "i3", ["x"]), row("8", "a", "z", 1, None, []), row("9", "a", "z", 1, None, [])], ROW)
    pairs = spark.createDataFrame([("1", "2", 90, "r2"), ("2", "3", 80, "r1"), ("2", "3", 80, "r1"), ("8", "9", 99, "r"), (None, "1", 1, "r"), ("1", "1", 1, "r")], "left_id string, right_id string, score int, reason string")
    got = entities.golden_entities(rows, pairs).collect()
    assert len(got) == 1  # 8 and 9 are of one store
    e = got[0]
    assert (e["base_row_id"], e["image_url"], e["price_reference"], e["confidence_score"], e["matching_rationale"]) == ("2", "i3", 40, 80, ["r2", "r1"])
    assert [v["silver_row_id"] for v in e["store_variants"]] == ["1", "2", "3"]
    assert entities.golden_entities(rows, pairs.limit(0)).collect() == []


def test_refresh_keeps_the_last_variant_and_the_smallest_confidence(spark):
    kind = "array<struct<store:string,silver_row_id:string,name_original:string,name_normalized:string,brand_normalized:string,effective_price:long,quality_flags:array<string>>>"
    v = [("b", "1", "viejo", "viejo", "M", 10, []), ("a", "2", "otro", "otro", None, None, None), ("b", "1", "nuevo", "nuevo nombre", "M", 0, []), ("c", None, "x", "x", None, 1, []), None]
    d = spark.createDataFrame([("g", 0, v), ("h", 95, []), ("i", 70, None)], f"gold_product_id string, confidence_score int, store_variants {kind}")
    got = {r["old_id"]: r for r in entities.refreshed_entities(d, spark.createDataFrame([("g", 80), ("h", 90)], "gold_product_id string, score int")).collect()}
    assert [x["name_original"] for x in got["g"]["store_variants"]] == ["otro", "nuevo"]
    assert (got["g"]["confidence_score"], got["g"]["name_canonical"], got["g"]["price_reference"]) == (80, "nuevo nombre", None)
    assert (got["h"]["confidence_score"], got["h"]["gold_product_id"], got["h"]["brand_canonical"], got["i"]["confidence_score"]) == (90, "h", "SIN MARCA", 70)


def test_counters_and_queue(spark):
    own = spark.createDataFrame([("e", "1"), ("e", "2"), ("f", "3"), ("f", None)], "entity string, member string")
    acc = spark.createDataFrame([("1", "2"), ("2", "3"), ("1", "9"), ("7", "8"), ("5", "5"), (None, "1")], "left_id string, right_id string")
    got = entities.integration_counters(own, acc).first()
    assert tuple(got) == (1, 1, 1, 1, 2)
    queue = spark.createDataFrame([("a",), ("b",), ("c",)], "review_item_id string")
    done = spark.createDataFrame([("a", 1, "accept"), ("b", 1, "accept"), ("b", 2, "escalate")], "review_item_id string, seq int, action string")
    assert sorted(r[0] for r in entities.remaining_reviews(queue, done).collect()) == ["b", "c"]
    p = spark.createDataFrame([(1, 2, 55), (1, 3, 40), (1, 4, 61)], "left_id int, right_id int, score int")
    assert [(r["right_id"], r["fallback"]) for r in entities.preview_topk(p).collect()] == [(4, False)]
    assert [(r["right_id"], r["fallback"]) for r in entities.preview_topk(p.filter("score < 60"), fallback=1).collect()] == [(2, True)]


def test_loads_and_quotes(spark):
    price = "id_precio int, id_producto_maestro int, id_retailer int, precio_clp decimal(12,2), disponibilidad boolean, link_producto string, fecha_captura timestamp"
    prices = spark.createDataFrame([(1, 1, 1, None, None, "u1", T), (2, 1, 1, None, True, "u1", T), (3, 2, 1, None, False, "u2", T)], price).withColumn("precio_clp", F.lit(10).cast("decimal(12,2)"))
    new = spark.createDataFrame([(1, "u1", 1, True, 10.4), (2, "u1", 1, None, 12.0), (3, "u1", 1, False, 1.0), (4, "u2", 1, False, 1.0), (5, "", 1, True, 1.0), (6, "u9", 1, True, 1.0), (7, "u1", 2, True, 5.0), (8, "u1", 1, True, None)], "id int, url string, id_retailer int, available boolean, price double")
    d = serving.daily_rows(new, spark.createDataFrame([("u1", 1), ("u1", 7), ("u2", 2), (None, 5)], "url string, product int"), prices)
    assert {(r["id"], r["action"], r["latest_id"]) for r in d.collect()} == {(2, "insert", None), (3, "unavailable", 2), (7, "insert", None)}
    assert [r["disponibilidad"] for r in serving.marked_unavailable(prices, d).orderBy("id_precio").collect()] == [None, False, False]
    lines = spark.createDataFrame([(1, 10, 1, 1, 1), (2, 20, 1, 1, 1)], "id_detalle int, id_cotizacion int, id_producto_maestro int, id_retailer int, cantidad int")
    quotes = spark.createDataFrame([(10, 5), (20, 6)], "id_cotizacion int, id_usuario int")
    fresh = spark.createDataFrame([(10, 3, 1, 4), (20, 3, 1, 4)], "id_cotizacion int, id_producto_maestro int, id_retailer int, cantidad int")
    assert sorted(map(tuple, serving.replaced_lines(lines, quotes, fresh, 5).collect())) == [(2, 20, 1, 1, 1), (3, 10, 3, 1, 4)]
    stores = spark.createDataFrame([(1, "uno", 2), (9, "nueve", 1)], "id_retailer int, tienda string, orden int")
    assert [(r["id_producto_maestro"], len(r["tiendas"])) for r in serving.offer_lists(prices, stores).orderBy("id_producto_maestro").collect()] == [(1, 1), (2, 1)]


def test_pages_sites_and_small_things(spark, tmp_path):
    stale = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "k int, p long").withColumn("disponibilidad", F.lit(True))
    seen = spark.createDataFrame([(1, True, None), (2, False, 9)], "k int, loaded boolean, p long")
    assert sorted((r["k"], r["p"], r["disponibilidad"]) for r in serving.refreshed_pages(stale, seen, ["k"], ["p"]).collect()) == [(1, 5, True), (2, 5, False), (3, None, False)]
    docs = spark.createDataFrame([("r.xml", "<loc>a.xml</loc><loc>p1</loc>"), ("a.xml", "<loc>r.xml</loc><loc>p2</loc><loc>b.xml</loc>"), ("x.xml", "<loc>p9</loc>")], "url string, xml string")
    assert sorted(r[0] for r in serving.walk_sitemaps(docs, ["r.xml"]).collect()) == ["p1", "p2"] and serving.walk_sitemaps(docs, ["r.xml"], 1).count() == 1
    assert serving.selected_stores(["a", "b", "c"], only=["c", "a"]) == ["a", "c"] and serving.selected_stores(["a"], named=["b", "b"]) == ["b"] and serving.selected_stores(["a"]) == ["a"]
    h = spark.createDataFrame([(1, dt.date(2026, 1, 1), 10.0), (1, dt.date(2026, 1, 11), 20.0), (2, dt.date(2026, 1, 1), 5.0)], "k int, d date, p double")
    assert sorted((r["k"], r["x"], r["y"]) for r in serving.chart_scale(h, ["k"], "d", "p", 0, 0, 100, 50).collect()) == [(1, 0.0, 50.0), (1, 100.0, 0.0), (2, 50.0, 25.0)]
    assert [r["valor"] for r in serving.price_ticks(h.filter("k = 1"), ["k"], "p").orderBy("tick").collect()] == [10, 13, 15, 18, 20]
    assert [r[0] for r in without_noise(spark.createDataFrame([("a RE: b",), (None,), ("c",)], "m string"), "m", ["re:"]).collect()] == [None, "c"]
    assert serving.scored_by(spark.range(3), lambda b: pd.DataFrame({"s": b["id"] * 2}), "s long").agg(F.sum("s")).first()[0] == 6
    urls = spark.createDataFrame([("https://x.cl/tubos-pvc",), ("https://x.cl/otro",)], "u string")
    assert store.url_matches_any(urls, F.col("u"), ["tubo"]).count() == 1 and store.url_matches_any(urls, F.col("u"), []).count() == 2
    assert write_gold(urls, urls, urls, f"file://{tmp_path}/g", dry_run=True) == {} and set(write_gold(urls, urls, urls, f"file://{tmp_path}/g")) == {"products", "review", "metrics"}
