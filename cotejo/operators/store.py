"""Operators over the price-comparison star schema: catalogue, history, quotes, loading, decisions.

Facts: price captures (product, retailer, price, availability, time).  All
functions take and return DataFrames; dimensions are joined without hints, so
that adaptive execution broadcasts what proves small.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.session import cut


def latest_with_ties(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows at the greatest time of their key; all of them where several share it."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order`` (which should be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Union in which, for each key, the row with the greatest ``order`` stays; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    cells = [c for c in both.columns if c not in (*keys, order, "_new")]
    top = F.max(F.struct(order, "_new", *cells)).alias("_t")
    return both.groupBy(*keys).agg(top).select(*keys, F.col("_t")[order].alias(order), *(F.col("_t")[c].alias(c) for c in cells))


def catalogue(products: DataFrame, prices: DataFrame, retailers: DataFrame, units: DataFrame) -> DataFrame:
    """Every product with its latest offer (ties kept) at every retailer and its unit label."""
    latest = latest_with_ties(prices, ["id_producto_maestro", "id_retailer"], "fecha_captura")
    d = latest.join(products, latest["id_producto_maestro"] == products["id_producto"]).join(retailers.select("id_retailer", "nombre_retailer"), "id_retailer")
    d = d.join(units.select("id_unidad", "abreviatura"), "id_unidad", "left")
    label = F.when(F.col("valor_medida").isNotNull() & F.col("abreviatura").isNotNull(), F.concat_ws(" ", F.col("valor_medida").cast("string"), "abreviatura")).otherwise("unidad")
    return d.select(
        "id_producto", "nombre_producto", "id_retailer", "nombre_retailer", F.col("precio_clp").cast("double").alias("precio"), F.coalesce("disponibilidad", F.lit(True)).alias("disponible"),
        "id_precio", label.alias("unidad"),
    )


def best_offers(offers: DataFrame) -> DataFrame:
    """For each product the cheapest available offer (the later retailer wins ties), else the first retailer's; with saving against the dearest.

    offers: one row for each product and retailer: id_producto, id_retailer, precio, disponible.
    """
    free = F.col("disponible") & F.col("precio").isNotNull()
    d = offers.groupBy("id_producto").agg(
        F.min(F.when(free, F.struct("precio", (-F.col("id_retailer")).alias("n")))).alias("b"), F.min(F.struct("id_retailer", "precio")).alias("f"), F.max("precio").alias("top"), F.count(F.lit(1)).alias("offers")
    )
    price, shop = F.coalesce(F.col("b.precio"), F.col("f.precio")), F.coalesce(-F.col("b.n"), F.col("f.id_retailer"))
    saving = F.floor(F.try_divide((F.col("top") - price) * 100, F.col("top")) + 0.5).cast("int")
    return d.select("id_producto", shop.cast("int").alias("id_retailer"), price.alias("precio"), F.col("top").alias("precio_maximo"), saving.alias("ahorro_pct"), "offers")


def price_changes(prices: DataFrame) -> DataFrame:
    """Each capture with its difference to the capture before it at the same retailer."""
    w = Window.partitionBy("id_producto_maestro", "id_retailer").orderBy("fecha_captura", "id_precio")
    p = F.col("precio_clp").cast("double")
    return prices.select("id_precio", "id_producto_maestro", "id_retailer", p.alias("precio"), F.round(p - F.lag(p).over(w), 2).alias("diferencia"))


def history_ranges(prices: DataFrame, ref: str, days: int) -> DataFrame:
    """Captures, distinct days and extremes of each product and retailer in the ``days`` before ``ref``."""
    d = prices.filter((F.col("fecha_captura") >= F.expr(f"timestamp'{ref}' - interval {int(days)} days")) & (F.col("fecha_captura") <= F.expr(f"timestamp'{ref}'")))
    p = F.col("precio_clp").cast("double")
    return d.groupBy("id_producto_maestro", "id_retailer").agg(
        F.count(F.lit(1)).alias("capturas"), F.countDistinct(F.to_date("fecha_captura")).alias("dias"), F.min(p).alias("minimo"), F.max(p).alias("maximo")
    )


def axis_ticks(history: DataFrame, key: str, day: str) -> DataFrame:
    """Days to label on a time axis for each key: all up to five, else the first, three at quarter steps and the last."""
    d = history.select(key, day).distinct()
    w = Window.partitionBy(key)
    d = d.withColumn("i", F.row_number().over(w.orderBy(day)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    step = F.floor(F.col("n") / 4)
    shown = (F.col("n") <= 5) | (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    for k in (1, 2, 3):
        shown = shown | (F.col("i") == step * k)
    return d.filter(shown).select(key, day)


def quote_totals(quotes: DataFrame, lines: DataFrame, offers: DataFrame) -> DataFrame:
    """Every quote with number of lines and total; lines without a price count 0. offers: one per product and retailer."""
    priced = lines.join(offers.select("id_producto_maestro", "id_retailer", "precio"), ["id_producto_maestro", "id_retailer"], "left")
    t = priced.groupBy("id_cotizacion").agg(F.count(F.lit(1)).alias("lineas"), F.sum(F.coalesce(F.col("precio") * F.col("cantidad"), F.lit(0.0))).alias("t"))
    return quotes.select("id_cotizacion").join(t, "id_cotizacion", "left").select("id_cotizacion", F.coalesce("lineas", F.lit(0)).alias("lineas"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


def quote_cards(lines: DataFrame, products: DataFrame, shown: int = 3) -> DataFrame:
    """First product names of every quote and how many more it has."""
    first = lines.join(products.select(F.col("id_producto").alias("id_producto_maestro"), "nombre_producto"), "id_producto_maestro")
    w = Window.partitionBy("id_cotizacion").orderBy("id_detalle")
    d = first.withColumn("i", F.row_number().over(w))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= shown, F.struct("i", "nombre_producto")))), lambda x: x["nombre_producto"]), " | ")
    return d.groupBy("id_cotizacion").agg(names.alias("items"), F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("mas"))


def restored_lines(lines: DataFrame, products: DataFrame, offers: DataFrame) -> DataFrame:
    """Lines of a saved quote against today's offers: unknown products drop out, a missing retailer becomes the product's first."""
    known = lines.join(products.select(F.col("id_producto").alias("id_producto_maestro")), "id_producto_maestro", "left_semi")
    first = offers.groupBy("id_producto_maestro").agg(F.min("id_retailer").alias("primero"))
    here = offers.select("id_producto_maestro", "id_retailer", F.col("id_retailer").alias("mismo")).distinct()
    d = known.join(here, ["id_producto_maestro", "id_retailer"], "left").join(first, "id_producto_maestro")
    return d.select("id_detalle", "id_producto_maestro", F.coalesce("mismo", "primero").alias("id_retailer"), "cantidad")


def change_only(new: DataFrame, prices: DataFrame) -> DataFrame:
    """New captures worth storing: never priced before, or another whole price than the latest.  new: id_producto_maestro, id_retailer, precio."""
    w = F.max_by(F.col("precio_clp").cast("double"), F.struct("fecha_captura", "id_precio")).alias("ultimo")
    last = prices.groupBy("id_producto_maestro", "id_retailer").agg(w)
    d = new.join(last, ["id_producto_maestro", "id_retailer"], "left")
    return d.filter(F.col("ultimo").isNull() | (F.rint("ultimo") != F.rint("precio")))


def daily_outcomes(refreshed: DataFrame, known_urls: DataFrame, last: DataFrame) -> DataFrame:
    """What becomes of each refreshed listing, first rule that applies: no_url, not_in_db, unavailable, no_price, unchanged, insert.

    refreshed: id, url, available, price.  known_urls: url, product (the
    smallest product of a URL counts).  last: product, last_price.
    """
    urls = known_urls.groupBy("url").agg(F.min("product").alias("product"))
    d = refreshed.join(urls, "url", "left").join(last, "product", "left")
    rule = (
        F.when(F.coalesce("url", F.lit("")) == "", "no_url").when(F.col("product").isNull(), "not_in_db").when(~F.coalesce("available", F.lit(True)), "unavailable")
        .when(F.coalesce("price", F.lit(0)) <= 0, "no_price").when(F.rint(F.col("price").cast("double")) == F.rint("last_price"), "unchanged").otherwise("insert")
    )
    return d.select("id", rule.alias("outcome"))


def get_or_create(wanted: DataFrame, dim: DataFrame, key: str, ident: str) -> DataFrame:
    """The dimension with the missing keys added; new ids follow the greatest existing one in key order.

    New keys are numbered without a global sort into one task: counts of the
    range partitions are summed up first.
    """
    fresh = wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(dim.select(key), key, "left_anti")
    top = dim.agg(F.coalesce(F.max(ident), F.lit(0)).alias("_top"))
    placed = fresh.repartitionByRange(key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))), "keys").df
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row for each partition
    added = placed.join(sizes, "_p").crossJoin(top).select((F.col("_top") + F.col("_before") + F.col("_i") + 1).cast("int").alias(ident), key)
    return dim.select(ident, key).unionByName(added)


def replayed_decisions(decisions: DataFrame, key: str, order: str, action: str) -> DataFrame:
    """The last decision of each pair, and of those the accepted ones (filtered after the replay)."""
    last = decisions.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, action)).alias("_l"))
    return last.filter(F.col("_l")[action] == "accept").select(key, F.col("_l")[order].alias(order))


def url_matches(pages: DataFrame, url: str, queries: DataFrame, query: str) -> DataFrame:
    """Pages whose URL slug contains a query word; queries: a handful of words on the driver's side of the join."""
    words = F.split(F.regexp_replace(F.lower(url), "[^a-z0-9]+", " "), " ")
    hit = F.array_contains(F.col("_w"), F.lower(F.col(query)))
    return pages.withColumn("_w", words).join(queries, hit, "left_semi").drop("_w")


def _overlaps(word: str):
    return lambda w: F.contains(w, F.lit(word)) | F.contains(F.lit(word), w)


def url_matches_any(pages: DataFrame, url: Column, queries: list[str]) -> DataFrame:
    """Pages of whose URL a word contains a word of a query or is contained in one; without queries all pages.

    Words have three letters or digits at least; queries come from a command
    line, so they are expressions and no table.
    """
    words = [w for q in queries for w in re.findall(r"[a-z0-9]{3,}", q.lower())]
    if not queries:
        return pages
    slug = F.filter(F.split(F.regexp_replace(F.lower(url), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) >= 3)
    hit = F.lit(False)
    for q in words:
        hit = hit | F.exists(slug, _overlaps(q))
    return pages.filter(hit)
