"""What the catalogue application asks for: offer lists, charts, loads with their rows, quotes, refresh of pages, site walks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.functions.pages import sitemap_locations
from cotejo.session import cut

PAIR = ["id_producto_maestro", "id_retailer"]


def offer_lists(prices: DataFrame, stores: DataFrame) -> DataFrame:
    """``id_producto_maestro`` and ``tiendas``: its latest offer at each of the ``stores``, in their order; stores without one are skipped.

    stores: ``id_retailer``, ``tienda``, ``orden`` (a fixed handful, so a list
    is short however many captures a product has).  Of several captures at the
    latest time the smallest id_precio counts.
    """
    p = prices.join(stores, "id_retailer")
    latest = p.groupBy("id_producto_maestro", "orden", "tienda").agg(F.max(F.struct("fecha_captura", (-F.col("id_precio")).alias("n"), "precio_clp", F.coalesce("disponibilidad", F.lit(True)).alias("stock"), "link_producto")).alias("o"))
    item = F.struct("orden", "tienda", F.col("o.precio_clp").alias("precio"), F.col("o.stock").alias("stock"), F.col("o.link_producto").alias("url"))
    return latest.groupBy("id_producto_maestro").agg(F.array_sort(F.collect_list(item)).alias("tiendas"))


def named_retailer(ident: Column, names: dict[int, str], default: str) -> Column:
    """Name of a retailer id; an unknown or null one has the default."""
    cells = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*cells), ident), F.lit(default)) if cells else F.lit(default)


def chart_scale(history: DataFrame, key: Sequence[str], day: str, price: str, left: float, top: float, width: float, height: float) -> DataFrame:
    """Each day and price of a series with its place in a chart (``x``, ``y``); a range of nothing is drawn in the middle.

    Extremes come from an aggregate that is joined back, so no series is held in one task.
    """
    d = history.withColumn("_d", F.unix_date(day))
    ends = d.groupBy(*key).agg(F.min("_d").alias("_d0"), F.max("_d").alias("_d1"), F.min(price).alias("_p0"), F.max(price).alias("_p1"))
    d = d.join(ends, list(key))
    x = F.when(F.col("_d1") == F.col("_d0"), F.lit(left + width / 2)).otherwise(left + F.try_divide(F.col("_d") - F.col("_d0"), F.col("_d1") - F.col("_d0")) * width)
    y = F.when(F.col("_p1") == F.col("_p0"), F.lit(top + height / 2)).otherwise(top + height - F.try_divide(F.col(price) - F.col("_p0"), F.col("_p1") - F.col("_p0")) * height)
    return d.select(*history.columns, x.alias("x"), y.alias("y"))


def price_ticks(history: DataFrame, key: Sequence[str], price: str, steps: int = 4) -> DataFrame:
    """``tick`` 0..steps of every series: evenly spaced whole prices from the lowest to the highest (halves up)."""
    ends = history.groupBy(*key).agg(F.min(price).alias("_p0"), F.max(price).alias("_p1")).withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    return ends.select(*key, "tick", F.floor(F.col("_p0") + (F.col("_p1") - F.col("_p0")) * F.col("tick") / steps + 0.5).cast("long").alias("valor"))


def daily_rows(refreshed: DataFrame, known_urls: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows that a daily load writes: ``action`` insert (a new price) or unavailable (the latest row of the pair to be marked), with product, retailer, price.

    refreshed: id, url, id_retailer, available, price.  known_urls: url, product.
    prices: captures.  Listings without URL, unknown ones, those without a price
    and those whose whole price is the latest one write nothing; a pair that is
    already unavailable isn't marked again.
    """
    urls = known_urls.filter("url is not null").groupBy("url").agg(F.min("product").alias("product"))
    top = F.max(F.struct("fecha_captura", "id_precio", "precio_clp", "disponibilidad")).alias("t")
    last = prices.groupBy(*PAIR).agg(top).select(F.col("id_producto_maestro").alias("product"), "id_retailer", F.col("t.precio_clp").cast("double").alias("_last"), F.coalesce("t.disponibilidad", F.lit(True)).alias("_was"), F.col("t.id_precio").alias("latest_id"))
    d = refreshed.filter(F.coalesce("url", F.lit("")) != "").join(urls, "url").join(last, ["product", "id_retailer"], "left")
    gone = ~F.coalesce("available", F.lit(True))
    moved = (F.col("price") > 0) & (F.col("_last").isNull() | (F.rint("_last") != F.rint("price")))
    action = F.when(gone, F.when(F.col("_was"), F.lit("unavailable"))).when(moved, F.lit("insert"))
    return d.withColumn("action", action).filter("action is not null").select("id", "action", "product", "id_retailer", F.when(F.col("action") == "insert", F.col("price")).alias("price"), F.when(F.col("action") == "unavailable", F.col("latest_id")).alias("latest_id"))


def marked_unavailable(prices: DataFrame, marks: DataFrame) -> DataFrame:
    """The captures with the availability of the marked ones (``latest_id``) set to false."""
    m = marks.filter("latest_id is not null").select(F.col("latest_id").alias("id_precio"), F.lit(True).alias("_off")).distinct()
    return prices.join(m, "id_precio", "left").withColumn("disponibilidad", F.when(F.col("_off"), F.lit(False)).otherwise(F.col("disponibilidad"))).drop("_off")


def checked_prices(new: DataFrame, products: DataFrame) -> DataFrame:
    """Add ``reject_reason`` to new captures: bad_price (not above 0, or more than two decimals), bad_url, unknown_product; null if accepted."""
    known = products.select(F.col("id_producto").alias("id_producto_maestro"), F.lit(True).alias("_known")).distinct()
    p = F.col("precio_clp").cast("decimal(38,6)")
    bad = ~F.coalesce((p > 0) & (F.round(p, 2) == p), F.lit(False))
    url = ~F.coalesce(F.col("link_producto").rlike(r"^https?://[^\s/?#]+\.[^\s/?#]+"), F.lit(False))
    d = new.join(known, "id_producto_maestro", "left")
    return d.withColumn("reject_reason", F.when(bad, "bad_price").when(url, "bad_url").when(F.col("_known").isNull(), "unknown_product")).drop("_known")


def replaced_lines(lines: DataFrame, quotes: DataFrame, new: DataFrame, user: int) -> DataFrame:
    """Quote lines after a user replaced those of some quotes: lines of quotes that aren't the user's own stay as they are.

    new: id_cotizacion, id_producto_maestro, id_retailer, cantidad; new lines get ids after the greatest one, in order.
    """
    own = quotes.filter(F.col("id_usuario") == user).select("id_cotizacion")
    ok = new.join(own, "id_cotizacion", "left_semi")
    kept = lines.join(ok.select("id_cotizacion").distinct(), "id_cotizacion", "left_anti")
    top = lines.agg(F.coalesce(F.max("id_detalle"), F.lit(0)).alias("_top"))
    # the lines of one user's request: few
    numbered = ok.withColumn("_n", F.row_number().over(Window.orderBy("id_cotizacion", "id_producto_maestro", "id_retailer", "cantidad"))).crossJoin(top)
    numbered = numbered.select((F.col("_top") + F.col("_n")).cast("int").alias("id_detalle"), "id_cotizacion", "id_producto_maestro", "id_retailer", "cantidad")
    return kept.select(*numbered.columns).unionByName(numbered)


def refreshed_pages(stale: DataFrame, pages: DataFrame, key: Sequence[str], prices: Sequence[str]) -> DataFrame:
    """Stale listings overlaid with what their pages say: a page that couldn't be loaded makes them unavailable, else a price above 0 makes them available.

    pages: key, ``loaded`` and the price columns; null prices of a page leave the old ones.
    """
    p = pages.select(*key, F.col("loaded").alias("_loaded"), *(F.col(c).alias(f"_{c}") for c in prices))
    d = stale.join(p, list(key), "left").withColumns({c: F.when(F.col("_loaded"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in prices})
    any_price = F.greatest(F.lit(0), *(F.coalesce(c, F.lit(0)) for c in prices)) > 0
    return d.withColumn("disponibilidad", F.coalesce(F.col("_loaded"), F.lit(False)) & any_price).drop("_loaded", *(f"_{c}" for c in prices))


def walk_sitemaps(documents: DataFrame, roots: Sequence[str], most: int | None = None) -> DataFrame:
    """``url`` of all pages that nested sitemaps below the roots list; a sitemap is read once, whoever links it.

    documents: ``url``, ``xml``.  Level by level the links that end in .xml and
    weren't visited are followed until none is left.  With ``most`` only the
    first pages in URL order are returned.
    """
    spark = documents.sparkSession
    front = spark.createDataFrame([(r,) for r in roots], "url string")
    seen, found = front, None
    while True:
        listed = cut(front.join(documents, "url").select(F.explode(sitemap_locations(F.col("xml"))).alias("url")).distinct(), "sitemap").df
        maps = F.lower(F.regexp_replace("url", r"[?#].*$", "")).endswith(".xml")
        pages = listed.filter(~maps & (F.col("url") != ""))
        found = pages if found is None else found.unionByName(pages)
        front = cut(listed.filter(maps).join(seen, "url", "left_anti"), "front").df
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    found = found.distinct()
    return found if most is None else found.orderBy("url").limit(most)


def scored_by(pairs: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Pairs scored by an outside model: ``scorer`` gets each Arrow batch as a pandas frame and returns one of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield scorer(b)

    return pairs.mapInPandas(run, schema)


def selected_stores(every: Sequence[str], only: Sequence[str] = (), named: Sequence[str] = ()) -> list[str]:
    """Stores to work on: the flagged ones in the usual order, else the named ones without repeats, else all."""
    if only:
        return [s for s in every if s in set(only)]
    return list(dict.fromkeys(named)) if named else list(every)


def run_summary(spark: SparkSession, name: str, figures: dict[str, object]) -> DataFrame:
    """One row for each observed figure of a run: ``stage``, ``figure``, ``value``."""
    return spark.createDataFrame([(name, k, int(v or 0)) for k, v in sorted(figures.items())], "stage string, figure string, value long")
