"""Feeds, hints, sinks, page reading and the streaming jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cotejo.functions import pages
from cotejo.sources.bronze import PRODUCT, REQUIRED, read_feeds, read_hints
from cotejo.sources.sinks import append_ledger, read_version, write_envelopes, write_version
from cotejo.streaming import refresh


def product(**kw):
    return dict.fromkeys(REQUIRED) | {"name": "Cemento", "product_url": "https://x.cl/a/p"} | kw


def test_feeds_and_hints(spark, tmp_path):
    short = product()
    del short["brand"]
    feed = {"total_products": 4, "products": [product(precio_normal=5), short, product(product_url=" "), "nada"]}
    (tmp_path / "easy.json").write_text(json.dumps(feed, indent=1))
    d = read_feeds(spark, {"easy": str(tmp_path / "easy.json")}).orderBy("pos")
    assert [r["reject_reason"] for r in d.collect()] == [None, "missing_keys", "blank_url", "not_object"]
    assert d.first()["precio_normal"] == 5
    (tmp_path / "h.json").write_text(json.dumps({"hints_by_product_url": {"https://x.cl/a/p/p?u=1": "https://x.cl/cat?x", "": "https://x.cl/c", "https://x.cl/b": ""}}))
    assert [tuple(r) for r in read_hints(spark, {"easy": str(tmp_path / "h.json")}).collect()] == [("easy", "https://x.cl/a/p", "https://x.cl/cat")]
    (tmp_path / "h2.json").write_text('{"hints": {"https://x.cl/z?1": "https://x.cl/zz", "https://x.cl/z?2": "https://x.cl/aa"}}')
    assert [r["category_url"] for r in read_hints(spark, {"easy": str(tmp_path / "h2.json"), "no": str(tmp_path / "none")}).collect()] == ["https://x.cl/aa"]
    (tmp_path / "bad.json").write_text("no json")
    with pytest.warns(UserWarning, match="no feed"):
        assert read_feeds(spark, {"a": str(tmp_path / "easy.json"), "b": str(tmp_path / "none.json")}).select("store").distinct().count() == 1
    with pytest.raises(Exception, match="no products array"):
        read_feeds(spark, {"easy": str(tmp_path / "bad.json")}).collect()
    assert read_feeds(spark, {}).collect() == [] and read_hints(spark, {}).collect() == []


def test_envelope_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", "b", "1", f"https://x.cl/{i}", i, None, None, None, None, None, None, None, None, True) for i in range(10)], PRODUCT)
    write_envelopes(d, str(tmp_path / "e"))
    back = read_feeds(spark, {"s": str(tmp_path / "e")})
    assert back.filter("reject_reason is not null").count() == 0
    assert sorted(r["precio_normal"] for r in back.collect()) == list(range(10))


def test_versions_and_ledger(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    write_version(spark.range(3), root)
    assert read_version(spark, root).count() == 3
    write_version(spark.range(5), root)
    assert read_version(spark, root).count() == 5
    for k in (0, 1, 1):  # the last batch is written twice
        append_ledger(spark.createDataFrame([(f"p{k}", "accept")], "k string, auto_action string"), f"{tmp_path}/l", "2026-01-01")
    back = spark.read.parquet(f"{tmp_path}/l")
    assert back.count() == 2 and back.select("tx_id").distinct().count() == 2


def test_pages(spark):
    html = '<a href="/x?sort=1">l</a><img srcset="/a.jpg 1x, /b.jpg 2x" src="data:image/x"><h3> Uno <b>dos</b></h3> sku: 12345'
    xml = "<urlset><url><loc> https://x.cl/1 </loc></url><ns:loc>https://x.cl/2</ns:loc></urlset>"
    d = spark.createDataFrame([(html, xml), ("", "roto <"), (None, None)], "h string, x string")
    first, *rest = d.select(
        pages.image_url(F.col("h"), "https://x.cl").alias("i"), pages.first_text(F.col("h"), ["<h1>(.*?)</h1>", "<h3>(.*?)</h3>"]).alias("t"), pages.links(F.col("h")).alias("l"),
        pages.sitemap_locations(F.col("x")).alias("s"), pages.sku_from_text(F.col("h")).alias("k"),
    ).collect()
    assert tuple(first) == ("https://x.cl/b.jpg", "Uno dos", ["/x?sort=1"], ["https://x.cl/1", "https://x.cl/2"], "12345")
    assert rest[0]["s"] == [] and rest[0]["t"] == "" and rest[1]["s"] is None
    urls = spark.createDataFrame([("https://x.cl/a?b=1",), ("https://x.cl/search/a",), ("https://x.cl/a?sort=1",), ("https://x.cl/filter/a",), (None,)], "u string")
    assert [r[0] for r in urls.select(pages.crawlable(F.col("u"))).collect()] == [True, False, False, False, True]
    noise = spark.createDataFrame([('Claro: {"a": {"b": 1}} listo',), ('{"a":1}',), ("nada",), (None,)], "t string")
    assert [r[0] for r in noise.select(pages.json_from_noise(F.col("t"))).collect()] == ['{"a": {"b": 1}}', '{"a":1}', None, None]


def test_stream_of_changes_in_batches(spark, tmp_path):
    schema = "id_producto_maestro int, id_retailer int, fecha_captura timestamp, id_precio int, precio_clp decimal(12,2)"
    t = dt.datetime(2026, 1, 1)
    prices = [10, 10, 20, 20, 20, 10, None, 10]
    for i, p in enumerate(prices):  # one file, and so one batch, for each capture
        row = spark.createDataFrame([(1, 1, t + dt.timedelta(days=i), i, p)], "a int, b int, c timestamp, d int, e int").selectExpr("a id_producto_maestro", "b id_retailer", "c fecha_captura", "d id_precio", "cast(e as decimal(12,2)) precio_clp")
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = refresh.price_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    refresh.run_changes(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["id_precio"] for r in refresh.read_changes(spark, f"{tmp_path}/out").collect()) == [0, 2, 5]
    refresh.run_changes(stream, str(tmp_path / "out"), str(tmp_path / "cp"))  # nothing new: nothing is added
    assert refresh.read_changes(spark, f"{tmp_path}/out").count() == 3
    late = spark.createDataFrame([(1, 1, t + dt.timedelta(hours=30), 90, 20)], "a int, b int, c timestamp, d int, e int").selectExpr("a id_producto_maestro", "b id_retailer", "c fecha_captura", "d id_precio", "cast(e as decimal(12,2)) precio_clp")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # older than the state: the capture after it is no change any more
    refresh.run_changes(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["id_precio"] for r in refresh.read_changes(spark, f"{tmp_path}/out").collect()) == [0, 5, 90]


def test_stream_windows_and_duplicates(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    spark.createDataFrame([(1, t + dt.timedelta(seconds=s)) for s in range(7)] + [(2, t)], "u int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema("u int, ts timestamp").parquet(str(tmp_path / "ev"))
    q = refresh.calls_per_window(s, "u", "ts").writeStream.format("memory").queryName("calls").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["u"], r["calls"]) for r in spark.sql("select * from calls").collect()] == [(1, 7)]
    schema = "id_producto_maestro int, id_retailer int, fecha_captura timestamp, id_precio int, precio_clp int"
    spark.createDataFrame([(1, 1, t, 1, 5), (1, 1, t, 2, 5), (1, 1, t, 3, 6)], schema).coalesce(1).write.parquet(str(tmp_path / "dup"))
    q = refresh.first_captures(spark.readStream.schema(schema).parquet(str(tmp_path / "dup"))).writeStream.format("memory").queryName("dups").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from dups").count() == 2
