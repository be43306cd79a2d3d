"""Queries of the catalogue application, loads, feeds, ledger and refresh jobs, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cotejo.functions import catalog as fn
from cotejo.functions import pages
from cotejo.operators import serving as ops
from cotejo.operators import store
from cotejo.plans.reference import PAIR, SQL as REFERENCE_SQL, _BRONZE, _bronze, _decisions, _KEY_SQL, _OFFERS, _offers
from cotejo.session import shared_dir
from cotejo.sources import bronze, sinks
from cotejo.sources.tables import table
from cotejo.streaming import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# --- catalogue and history
@query("SELECT id_producto_maestro, id_retailer, id_precio, precio_clp::DOUBLE AS precio, fecha_captura::DATE::VARCHAR AS dia FROM precio_retailer ORDER BY id_producto_maestro, fecha_captura, id_precio")
def price_history_all(spark: SparkSession, sf: str) -> DataFrame:
    """The history of every product, each in order of time (a range sort, so a hot product is spread)."""
    p = table(spark, sf, "precio_retailer").orderBy("id_producto_maestro", "fecha_captura", "id_precio")
    return p.select(*PAIR, "id_precio", F.col("precio_clp").cast("double").alias("precio"), F.to_date("fecha_captura").cast("string").alias("dia"))


@query("SELECT id_producto, nombre_producto FROM producto_maestro ORDER BY nombre_producto, id_producto LIMIT 72")
def catalogue_page(spark: SparkSession, sf: str) -> DataFrame:
    """Three pages of 24 products by name: the limit is the feature."""
    return table(spark, sf, "producto_maestro").select("id_producto", "nombre_producto").orderBy("nombre_producto", "id_producto").limit(24 * 3)


@query("SELECT DISTINCT product_url FROM bronze_product ORDER BY 1 LIMIT 5")
def first_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bronze_product").select("product_url").distinct().orderBy("product_url").limit(5)


@query("""SELECT p.id_producto_maestro, m.nombre_producto, count(DISTINCT id_retailer) AS tiendas FROM precio_retailer p JOIN producto_maestro m ON m.id_producto = p.id_producto_maestro GROUP BY 1, 2
HAVING count(DISTINCT id_retailer) >= 3 ORDER BY tiendas DESC, id_producto_maestro LIMIT 20""")
def multi_store_examples(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "precio_retailer").groupBy("id_producto_maestro").agg(F.countDistinct("id_retailer").alias("tiendas")).filter("tiendas >= 3")
    m = table(spark, sf, "producto_maestro").select(F.col("id_producto").alias("id_producto_maestro"), "nombre_producto")
    return n.join(m, "id_producto_maestro").orderBy(F.desc("tiendas"), "id_producto_maestro").limit(20)


@query("""WITH l AS (SELECT * FROM precio_retailer QUALIFY row_number() OVER (PARTITION BY id_producto_maestro, id_retailer ORDER BY fecha_captura DESC, id_precio) = 1)
SELECT id_producto_maestro, string_agg(r.store || ' ' || precio_clp::DOUBLE::BIGINT || ' ' || coalesce(disponibilidad, true)::VARCHAR, ';' ORDER BY r.id_retailer) AS tiendas FROM l JOIN store_rank r USING (id_retailer) WHERE r.store IS NOT NULL AND precio_clp IS NOT NULL GROUP BY 1""")
def catalogue_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Offers of every product at the six stores, in the stores' fixed order."""
    stores = table(spark, sf, "store_rank").filter("store is not null").select("id_retailer", F.col("store").alias("tienda"), F.col("id_retailer").alias("orden"))
    d = ops.offer_lists(table(spark, sf, "precio_retailer"), stores)
    shown = F.filter(F.col("tiendas"), lambda o: o["precio"].isNotNull())
    text = F.transform(shown, lambda o: F.concat_ws(" ", o["tienda"], F.floor(o["precio"].cast("double") + 0.0).cast("string"), o["stock"].cast("string")))
    return d.filter(F.size(shown) > 0).select("id_producto_maestro", F.array_join(text, ";").alias("tiendas"))


SQL["catalogue_offers"] = SQL["catalogue_offers"].replace("precio_clp::DOUBLE::BIGINT", "floor(precio_clp::DOUBLE)::BIGINT")


@query("""WITH l AS (SELECT * FROM precio_retailer QUALIFY row_number() OVER (PARTITION BY id_producto_maestro, id_retailer ORDER BY fecha_captura DESC, id_precio) = 1)
SELECT m.id_producto AS id_producto_maestro, m.nombre_producto, string_agg(lower(trim(r.nombre_retailer)) || ' ' || l.id_precio, ';' ORDER BY r.id_retailer) AS ofertas
FROM producto_maestro m JOIN l ON l.id_producto_maestro = m.id_producto JOIN store_rank r USING (id_retailer) WHERE m.nombre_producto ILIKE '%cemento%' GROUP BY 1, 2""")
def search_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Search with one list of latest offers for each product."""
    m = table(spark, sf, "producto_maestro").filter(F.col("nombre_producto").ilike("%cemento%")).select(F.col("id_producto").alias("id_producto_maestro"), "nombre_producto")
    p = store.latest_row(table(spark, sf, "precio_retailer").join(m, "id_producto_maestro"), PAIR, [F.desc("fecha_captura"), F.col("id_precio")])
    d = p.join(table(spark, sf, "store_rank").select("id_retailer", "nombre_retailer"), "id_retailer")
    offers = F.array_sort(F.collect_list(F.struct("id_retailer", F.lower(F.trim("nombre_retailer")).alias("t"), "id_precio")))
    return d.groupBy("id_producto_maestro", "nombre_producto").agg(F.array_join(F.transform(offers, lambda o: F.concat_ws(" ", o["t"], o["id_precio"].cast("string"))), ";").alias("ofertas"))


@query("""SELECT id_precio, CASE id_retailer WHEN 1 THEN 'Ferralto' WHEN 3 THEN 'Maderix' ELSE 'Otra' END AS tienda FROM precio_retailer""")
def retailer_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "precio_retailer").select("id_precio", ops.named_retailer(F.col("id_retailer"), {1: "Ferralto", 3: "Maderix"}, "Otra").alias("tienda"))


_PT = "SELECT id_producto_maestro, id_retailer, id_precio, fecha_captura::DATE AS dia, precio_clp::DOUBLE AS precio FROM precio_retailer WHERE precio_clp > 0"


@query(f"""WITH p AS ({_PT}), e AS (SELECT *, min(dia) OVER w AS d0, max(dia) OVER w AS d1, min(precio) OVER w AS p0, max(precio) OVER w AS p1 FROM p WINDOW w AS (PARTITION BY id_producto_maestro))
SELECT id_precio, round(CASE WHEN d1 = d0 THEN 290 ELSE 40 + (dia - d0)::DOUBLE / (d1 - d0) * 500 END, 3) AS x, round(CASE WHEN p1 = p0 THEN 110 ELSE 10 + 200 - (precio - p0) / (p1 - p0) * 200 END, 3) AS y FROM e""")
def chart_points(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "precio_retailer").filter("precio_clp > 0").select("id_producto_maestro", "id_precio", F.to_date("fecha_captura").alias("dia"), F.col("precio_clp").cast("double").alias("precio"))
    return ops.chart_scale(p, ["id_producto_maestro"], "dia", "precio", 40, 10, 500, 200).select("id_precio", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"""WITH p AS ({_PT}), e AS (SELECT id_producto_maestro, min(precio) AS p0, max(precio) AS p1 FROM p GROUP BY 1)
SELECT id_producto_maestro, i::INT AS tick, floor(p0 + (p1 - p0) * i / 4 + 0.5)::BIGINT AS valor FROM e, range(0, 5) t(i)""")
def chart_price_ticks(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "precio_retailer").filter("precio_clp > 0").select("id_producto_maestro", F.col("precio_clp").cast("double").alias("precio"))
    return ops.price_ticks(p, ["id_producto_maestro"], "precio")


@query("SELECT id_producto_maestro, id_retailer, id_precio, coalesce(disponibilidad, true) AS disponible FROM precio_retailer QUALIFY row_number() OVER (PARTITION BY id_producto_maestro, id_retailer ORDER BY fecha_captura DESC, id_precio DESC) = 1")
def latest_single(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly one latest capture of each pair; ranks are limited before the exchange, so a hot pair sends one row for each task."""
    d = store.latest_row(table(spark, sf, "precio_retailer"), PAIR, [F.desc("fecha_captura"), F.desc("id_precio")])
    return d.select(*PAIR, "id_precio", F.coalesce("disponibilidad", F.lit(True)).alias("disponible"))


@query("""SELECT (SELECT count(*) FROM producto_maestro) AS productos, (SELECT count(*) FROM precio_retailer) AS precios, (SELECT count(DISTINCT id_producto_maestro) FROM precio_retailer) AS con_precio""")
def global_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "precio_retailer").agg(F.count(F.lit(1)).alias("precios"), F.countDistinct("id_producto_maestro").alias("con_precio"))
    return table(spark, sf, "producto_maestro").agg(F.count(F.lit(1)).alias("productos")).crossJoin(p)  # one row each


# --- loads and quotes
@query(f"""WITH u AS (SELECT link_producto AS url, min(id_producto_maestro) AS product FROM precio_retailer GROUP BY 1),
l AS (SELECT id_producto_maestro AS product, id_retailer, precio_clp::DOUBLE AS lp, coalesce(disponibilidad, true) AS was, id_precio AS lid FROM precio_retailer QUALIFY row_number() OVER (PARTITION BY id_producto_maestro, id_retailer ORDER BY fecha_captura DESC, id_precio DESC) = 1),
x AS (SELECT id_precio AS id, link_producto AS url, id_retailer, disponibilidad AS a, precio_clp::DOUBLE AS p FROM precio_retailer)
SELECT id, action, product, id_retailer, CASE WHEN action = 'insert' THEN p END AS price, CASE WHEN action = 'unavailable' THEN lid END AS latest_id FROM (
  SELECT *, CASE WHEN NOT coalesce(a, true) THEN CASE WHEN was THEN 'unavailable' END WHEN p > 0 AND (lp IS NULL OR round_even(lp, 0) <> round_even(p, 0)) THEN 'insert' END AS action
  FROM x JOIN u USING (url) LEFT JOIN l USING (product, id_retailer) WHERE url <> '') WHERE action IS NOT NULL""")
def daily_load_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What a load of all captures against the latest ones would write."""
    p = table(spark, sf, "precio_retailer")
    new = p.select(F.col("id_precio").alias("id"), F.col("link_producto").alias("url"), "id_retailer", F.col("disponibilidad").alias("available"), F.col("precio_clp").cast("double").alias("price"))
    return ops.daily_rows(new, p.select(F.col("link_producto").alias("url"), F.col("id_producto_maestro").alias("product")), p)


@query("""SELECT coalesce(CASE WHEN NOT coalesce(p > 0 AND round(p, 2) = p, false) THEN 'bad_price' WHEN NOT regexp_matches(link_producto, '^https?://[^\\s/?#]+\\.[^\\s/?#]+') THEN 'bad_url' WHEN m.id_producto IS NULL THEN 'unknown_product' END, 'ok') AS resultado, count(*) AS filas
FROM (SELECT *, CASE WHEN id_precio % 7 = 0 THEN precio_clp + 0.005 ELSE precio_clp END AS p, CASE WHEN id_precio % 5 = 0 THEN id_producto_maestro + 1000000 ELSE id_producto_maestro END AS k FROM precio_retailer) LEFT JOIN producto_maestro m ON m.id_producto = k GROUP BY 1""")
def price_insert_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Captures as new payloads, a part of them with a third decimal or an unknown product, by the reason they are rejected for."""
    p = table(spark, sf, "precio_retailer")
    price = F.when(F.col("id_precio") % 7 == 0, F.col("precio_clp").cast("decimal(14,3)") + F.lit("0.005").cast("decimal(4,3)")).otherwise(F.col("precio_clp"))
    new = p.select(F.when(F.col("id_precio") % 5 == 0, F.col("id_producto_maestro") + 1000000).otherwise(F.col("id_producto_maestro")).alias("id_producto_maestro"), price.alias("precio_clp"), "link_producto")
    return ops.checked_prices(new, table(spark, sf, "producto_maestro")).groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("resultado")).agg(F.count(F.lit(1)).alias("filas"))


@query("""WITH own AS (SELECT id_cotizacion FROM cotizacion WHERE id_usuario = 2), n AS (SELECT id_cotizacion, id_producto_maestro, id_retailer, cantidad + 1 AS cantidad FROM detalle_cotizacion WHERE cantidad > 3 AND id_cotizacion IN (SELECT id_cotizacion FROM own))
SELECT id_detalle, id_cotizacion, id_producto_maestro, id_retailer, cantidad FROM detalle_cotizacion WHERE id_cotizacion NOT IN (SELECT id_cotizacion FROM n)
UNION ALL SELECT ((SELECT max(id_detalle) FROM detalle_cotizacion) + row_number() OVER (ORDER BY id_cotizacion, id_producto_maestro, id_retailer, cantidad))::INT, id_cotizacion, id_producto_maestro, id_retailer, cantidad FROM n""")
def quote_replace(spark: SparkSession, sf: str) -> DataFrame:
    """One user replaces the lines of quotes with more than three of something; those of others in the request are ignored."""
    d = table(spark, sf, "detalle_cotizacion")
    new = d.filter("cantidad > 3").select("id_cotizacion", "id_producto_maestro", "id_retailer", (F.col("cantidad") + 1).alias("cantidad"))
    return ops.replaced_lines(d, table(spark, sf, "cotizacion"), new, 2)


@query(f"""WITH s AS (SELECT store, {_KEY_SQL} AS url, max({{'d': snapshot_date, 'n': precio_normal, 'o': precio_oferta}}) AS t FROM bronze_snapshot GROUP BY 1, 2),
b AS (SELECT silver_row_id, store, {_KEY_SQL} AS url, precio_normal, precio_oferta FROM {_BRONZE} WHERE fecha_ultima_revision IS DISTINCT FROM '2026-06-28')
SELECT silver_row_id, coalesce(t.n, precio_normal) AS precio_normal, coalesce(t.o, precio_oferta) AS precio_oferta, t IS NOT NULL AND greatest(coalesce(t.n, precio_normal, 0), coalesce(t.o, precio_oferta, 0)) > 0 AS disponibilidad FROM b LEFT JOIN s USING (store, url)""")
def product_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Stale listings overlaid with the prices of their latest delivery; listings that none holds count as not loaded."""
    s = table(spark, sf, "bronze_snapshot").withColumn("url", fn.lookup_url(F.col("product_url")))
    s = s.groupBy("store", "url").agg(F.max(F.struct("snapshot_date", "precio_normal", "precio_oferta")).alias("t")).select("store", "url", F.lit(True).alias("loaded"), "t.precio_normal", "t.precio_oferta")
    stale = _bronze(spark, sf).join(table(spark, sf, "bronze_product").groupBy("silver_row_id").agg(F.max("fecha_ultima_revision").alias("f")), "silver_row_id").filter(~F.col("f").eqNullSafe(F.lit("2026-06-28")))
    stale = stale.select("silver_row_id", "store", fn.lookup_url(F.col("product_url")).alias("url"), "precio_normal", "precio_oferta")
    return ops.refreshed_pages(stale, s, ["store", "url"], ["precio_normal", "precio_oferta"]).select("silver_row_id", "precio_normal", "precio_oferta", "disponibilidad")


# --- feeds, hints, ledger, logs, runs
@query("SELECT store, coalesce(CASE WHEN trim(coalesce(product_url, '')) = '' THEN 'blank_url' END, 'ok') AS resultado, count(*) AS filas, sum(coalesce(precio_normal, 0))::BIGINT AS suma FROM bronze_product GROUP BY 1, 2")
def feed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All listings written as feeds of their stores and read back through the feed validation."""
    b, out = table(spark, sf, "bronze_product"), _place(spark, "feeds")
    stores = [r[0] for r in table(spark, sf, "store_rank").filter("store is not null").select("store").orderBy("id_retailer").collect()]
    fields = [c.split()[0] for c in bronze.PRODUCT.split(", ")]
    for s in stores:
        sinks.write_envelopes(b.filter(F.col("store") == s).select(*fields), f"{out}/{s}")
    d = bronze.read_feeds(spark, {s: f"{out}/{s}" for s in stores})
    return d.groupBy("store", F.coalesce("reject_reason", F.lit("ok")).alias("resultado")).agg(F.count(F.lit(1)).alias("filas"), F.sum(F.coalesce("precio_normal", F.lit(0))).alias("suma"))


@query("""SELECT DISTINCT 'todas' AS store, regexp_replace(regexp_replace(trim(product_url), '[?#].*$', ''), '(/p)(/p)+$', '/p') AS product_url, regexp_extract(product_url, '^[^/]*//[^/]*/[^/]*') AS category_url FROM bronze_product""")
def hints_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Category hints of all listings written and read back."""
    out = _place(spark, "hints")
    h = table(spark, sf, "bronze_product").select("product_url", F.regexp_extract("product_url", "^[^/]*//[^/]*/[^/]*", 0).alias("category_url"))
    sinks.write_hints(h, out)
    return bronze.read_hints(spark, {"todas": out})


@query(REFERENCE_SQL["ledger_replay"])
def ledger_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions appended to a ledger in three batches, the last one twice, and replayed from it."""
    out = _place(spark, "ledger")
    d = _decisions(spark, sf).select("k", "review_item_id", "auto_action")
    for b in (0, 1, 2, 2):
        sinks.append_ledger(d.filter(F.pmod(F.xxhash64("review_item_id"), F.lit(3)) == b), out, "2026-06-28")
    return store.replayed_decisions(spark.read.parquet(out), "k", "review_item_id", "auto_action")


@query("SELECT doc_id, subject FROM documents WHERE NOT coalesce(contains(lower(subject), 'newsletter') OR contains(lower(subject), 're:'), false)")
def log_filter(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.without_noise(table(spark, sf, "documents").select("doc_id", "subject"), "subject", ["newsletter", "RE:"])


@query("""SELECT 'bronze' AS stage, f AS figure, v::BIGINT AS value FROM (SELECT count(*) AS total, count(*) FILTER (coalesce(sku_store, '') <> '') AS with_sku, count(precio_tarjeta) AS with_tarjeta FROM bronze_product) UNPIVOT (v FOR f IN (total, with_sku, with_tarjeta))""")
def run_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures observed while the listings are written, without a pass of their own."""
    seen = Observation("bronze")
    d = table(spark, sf, "bronze_product").observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("sku_store", F.lit("")) != "").alias("with_sku"), F.count("precio_tarjeta").alias("with_tarjeta"))
    d.write.parquet(_place(spark, "observed"))
    return ops.run_summary(spark, "bronze", seen.get)


@query("""SELECT DISTINCT left_product.silver_row_id AS izquierda, right_product.silver_row_id AS derecha, CASE WHEN left_product.brand_normalized = right_product.brand_normalized THEN 'MATCH' ELSE 'UNSURE' END AS veredicto
FROM gold_review_llm_decisions""")
def scorer_hook(spark: SparkSession, sf: str) -> DataFrame:
    """The review queue through the hook for an outside scorer, with a fixed rule in its place."""
    d = table(spark, sf, "gold_review_llm_decisions").select(*(F.col(f"{p}_product.{c}").alias(f"{p}_{c}") for p in ("left", "right") for c in ("silver_row_id", "brand_normalized")))

    def rule(b: pd.DataFrame) -> pd.DataFrame:
        same = (b["left_brand_normalized"] == b["right_brand_normalized"]) & b["left_brand_normalized"].notna()
        return pd.DataFrame({"izquierda": b["left_silver_row_id"], "derecha": b["right_silver_row_id"], "veredicto": same.map({True: "MATCH", False: "UNSURE"})})

    return ops.scored_by(d, rule, "izquierda string, derecha string, veredicto string").distinct()


@query("SELECT unnest(['maderix', 'ferralto']) AS store, unnest([1, 2]) AS orden")
def store_selection(spark: SparkSession, sf: str) -> DataFrame:
    every = [r[0] for r in table(spark, sf, "store_rank").filter("store is not null").orderBy("id_retailer").select("store").collect()]
    picked = ops.selected_stores(every, named=["maderix", "ferralto", "maderix"])
    return spark.createDataFrame([(s, i + 1) for i, s in enumerate(picked)], "store string, orden int")


@query("SELECT DISTINCT product_url AS url FROM bronze_product WHERE NOT regexp_matches(lower(regexp_replace(product_url, '[?#].*$', '')), '\\.xml$')")
def sitemap_walk(spark: SparkSession, sf: str) -> DataFrame:
    """All product pages found again through a root, store and page sitemaps (with a cycle)."""
    b = table(spark, sf, "bronze_product").select("store", "product_url").distinct().withColumn("n", F.pmod(F.xxhash64("product_url"), F.lit(16)))
    loc = lambda c: F.concat(F.lit("<loc>"), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    leaf = b.select(F.format_string("https://%s/%d-%d.xml", "store", "n", F.pmod(F.xxhash64("product_url", F.lit(1)), F.lit(64))).alias("url"), "store", loc(F.col("product_url")).alias("x"))
    leaves = leaf.groupBy("url", "store").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("x"), ""), F.lit("<loc>https://raiz/sitemap.xml</loc></urlset>")).alias("xml"))
    maps = leaves.groupBy("store").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(loc(F.col("url"))), ""), F.lit("</sitemapindex>")).alias("xml")).select(F.format_string("https://%s/sitemap.xml", "store").alias("url"), "xml")
    root = maps.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(loc(F.col("url"))), ""), F.lit("</sitemapindex>")).alias("xml")).select(F.lit("https://raiz/sitemap.xml").alias("url"), "xml")
    return ops.walk_sitemaps(root.unionByName(maps).unionByName(leaves.select("url", "xml")), ["https://raiz/sitemap.xml"])


@query(f"SELECT store, {_KEY_SQL} AS url, max(snapshot_date) AS snapshot_date FROM bronze_snapshot GROUP BY 1, 2")
def stream_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The daily refresh as a streaming job over all deliveries, in several batches."""
    out = _place(spark, "refresh")
    s = table(spark, sf, "bronze_snapshot").select("store", fn.lookup_url(F.col("product_url")).alias("url"), "snapshot_date")
    s.repartition(4, "snapshot_date").write.parquet(f"{out}/in")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/in")
    refresh.run_refresh(stream, f"{out}/table", f"{out}/checkpoint", ["store", "url"], "snapshot_date")
    return sinks.read_version(spark, f"{out}/table")


@query("SELECT user_id, date_trunc('day', ts) AS dia, count(*) AS llamadas FROM events GROUP BY 1, 2 HAVING count(*) > 5")
def rate_limit_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Callers above the limit, by the streaming window job (a day wide, since the events are sparse)."""
    out = _place(spark, "calls")
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{out}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{out}/in")
    name = f"calls_{uuid.uuid4().hex[:8]}"

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/calls")

    calls = refresh.calls_per_window(stream, "user_id", "ts", "1 day", 5)
    calls.writeStream.queryName(name).outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/calls").select("user_id", F.col("start").cast("timestamp_ntz").alias("dia"), F.col("calls").alias("llamadas"))


@query("""SELECT fecha_captura::DATE::VARCHAR AS dia, count(*) AS capturas FROM (SELECT DISTINCT id_producto_maestro, id_retailer, fecha_captura, precio_clp FROM precio_retailer) GROUP BY 1""")
def stream_first_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Captures without those loaded twice, by the streaming job, counted by day."""
    out = _place(spark, "dups")
    p = table(spark, sf, "precio_retailer").select(*PAIR, "fecha_captura", "id_precio", "precio_clp")
    p.write.parquet(f"{out}/in")
    d = refresh.first_captures(refresh.price_stream(spark, f"{out}/in", p.schema), "4000 days")
    d.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/out").groupBy(F.to_date("fecha_captura").cast("string").alias("dia")).agg(F.count(F.lit(1)).alias("capturas"))


# --- texts and URLs
@query("""SELECT DISTINCT product_url, split_part(split_part(product_url, '#', 1), '?', 1) AS limpia, regexp_replace(split_part(split_part(product_url, '#', 1), '?', 1), '(/p)(/p)+$', '/p') || CASE WHEN contains(split_part(product_url, '#', 1), '?') AND split_part(split_part(product_url, '#', 1), '?', 2) <> ''
 THEN '?' || substr(split_part(product_url, '#', 1), strpos(split_part(product_url, '#', 1), '?') + 1) ELSE '' END AS ficha FROM bronze_snapshot""")
def url_clean(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "bronze_snapshot").select("product_url").distinct()
    return u.select("product_url", fn.bare_url(F.col("product_url")).alias("limpia"), fn.listing_url(F.col("product_url")).alias("ficha"))


@query("""WITH b AS (SELECT DISTINCT product_url AS u, list_filter(string_split(regexp_extract(product_url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM bronze_product)
SELECT u AS product_url, coalesce(CASE WHEN regexp_full_match(s[-1], '\\d+') AND len(s) >= 2 THEN s[-2] ELSE s[-1] END, '') AS slug FROM b""")
def url_slugs(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "bronze_product").select("product_url").distinct()
    return u.select("product_url", fn.slug(F.col("product_url")).alias("slug"))


@query("""SELECT id_retailer, array_to_string(list_transform(list_filter(string_split(trim(nombre_retailer), ' '), lambda w: w <> ''), lambda w: upper(w[1])), '') AS iniciales,
'https://x.example/search?q=' || replace(array_to_string(list_filter(string_split(regexp_replace(lower(strip_accents(nombre_retailer)), '[^a-z0-9\\s]', ' ', 'g'), ' '), lambda w: len(w) >= 3), ' '), ' ', '+') AS busqueda FROM store_rank""")
def retailer_texts(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "store_rank")
    return r.select("id_retailer", fn.initials(F.col("nombre_retailer")).alias("iniciales"), fn.search_url("https://x.example", F.col("nombre_retailer")).alias("busqueda"))


@query("""SELECT DISTINCT product_url FROM bronze_product WHERE len(list_filter(string_split(regexp_replace(lower(product_url), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: len(w) >= 3 AND (contains(w, 'cement') OR contains('cement', w) OR contains(w, 'tubos') OR contains('tubos', w)))) > 0""")
def url_query_substring(spark: SparkSession, sf: str) -> DataFrame:
    return store.url_matches_any(table(spark, sf, "bronze_product").select("product_url").distinct(), F.col("product_url"), ["Cement", "tubos"])


@query("""SELECT DISTINCT silver_row_id, CASE WHEN regexp_matches(image_url, '^https?://') THEN image_url WHEN image_url LIKE '//%' THEN 'https:' || image_url WHEN image_url LIKE '/%' THEN 'https://x.example' || image_url ELSE 'https://x.example/' || image_url END AS imagen
FROM bronze_product WHERE coalesce(image_url, '') <> '' AND NOT starts_with(image_url, 'data:') AND NOT contains(image_url, '"') AND NOT contains(image_url, '''')""")
def page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Image addresses read from a page whose picture stands in a lazy-loading attribute."""
    b = table(spark, sf, "bronze_product").filter("coalesce(image_url, '') <> '' and not startswith(image_url, 'data:') and not contains(image_url, '\"') and not contains(image_url, \"'\")")
    page = F.concat(F.lit('<div><img class="x" src="data:image/gif;base64,R0" data-src="'), "image_url", F.lit('"></div>'))
    return b.select("silver_row_id", pages.image_url(page, "https://x.example").alias("imagen")).distinct()


@query(f"SELECT id_producto_maestro, id_retailer, round_even(precio / 3, 0)::BIGINT AS entero FROM {_OFFERS}")
def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _offers(spark, sf).select(*PAIR, fn.parse_number(F.col("precio") / 3).alias("entero"))


@query("SELECT product_url, substr(sha1(coalesce(store, '') || '|' || coalesce(sku_store, '') || '|' || product_url), 1, 16) AS id, count(*) AS n FROM bronze_snapshot GROUP BY ALL")
def short_ids(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "bronze_snapshot")
    return s.groupBy("product_url", fn.short_id(F.col("store"), F.col("sku_store"), F.col("product_url")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
