"""Quantities recorded in different units.

Every way of writing a unit is a *source*.  Two sources are linked where one
entity has a value in both: a listing's unit price and its price over the
contents that its name states, the unit prices of two listings of one article
at different shops, or a product's recorded measure and the contents in its
name.  Scale and offset of each linked pair of sources are estimated robustly
(medians over all links), freed of the bias that known spellings show, and
propagated over the graph of sources from the common units, each step being
snapped to a known conversion.  The propagated factor gives the rows.  What a
unit is called only chooses between conversions that the links leave open,
vetoes words that name no unit, and stands in for spellings with too few links.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.text import let
from cotejo.functions.units import CONVERSIONS, price_phrase, stated, unit_map, unit_phrase
from cotejo.session import cut

#: links that an estimate needs; a spelling with fewer than FEW_LINKS that no estimate reaches is taken by its name
MIN_LINKS, FEW_LINKS = 5, 30
#: how far from a known conversion an estimate may lie (in log units)
TOLERANCE = 0.12
#: share of a source's links that must lie in the magnitude it is given (words that name no unit spread over several), and the spread allowed
SHARE = 2 / 3
SPREAD = 0.15
# fixed values: words that a unit field holds though they name no unit (a package without stated contents)
NO_UNITS = (
    "otro", "otros", "servicio", "pallet", "palet", "bulto", "caja", "juego", "set", "kit", "pack", "paquete", "saco", "bolsa", "balde", "tineta", "tambor", "bidon", "rollo",
    "tira", "plancha", "lata", "tarro", "display", "blister", "estuche", "envase",
)


def pair_scales(links: DataFrame, by: Sequence[str] = ("source", "target"), accuracy: int = 1000) -> DataFrame:
    """Robust scale and offset between linked sources.

    links: ``source``, ``target``, ``x`` (value in source), ``y`` (value in
    target) of one entity each; y = scale * x + offset.  Result for each pair:
    ``scale`` (median ratio), ``offset`` (median residual), ``spread`` (median
    absolute deviation of the log ratio), ``n``.  Links without two positive
    values are left out.  Percentile sketches aggregate partially, so a hot
    source is reduced before the exchange.
    """
    ok = links.filter("x > 0 and y > 0").withColumn("_r", F.log(F.col("y") / F.col("x")))
    mid = ok.groupBy(*by).agg(F.percentile_approx("_r", 0.5, accuracy).alias("_m"), F.count(F.lit(1)).alias("n"))
    # one row for each pair of source spellings
    dev = ok.join(mid.drop("n"), list(by)).groupBy(*by).agg(
        F.percentile_approx(F.abs(F.col("_r") - F.col("_m")), 0.5, accuracy).alias("spread"),
        F.percentile_approx(F.col("y") - F.col("x") * F.exp("_m"), 0.5, accuracy).alias("offset"),
    )
    return mid.join(dev, list(by)).select(*by, F.exp("_m").alias("scale"), "offset", "spread", "n")


def snap(scale: Column, target: Column, tolerance: float = TOLERANCE, error: Column | float = 0.0, named: Column | None = None) -> Column:
    """The known conversion nearest to ``scale`` (in log distance) for a common unit; null beyond the tolerance.

    If the next conversion is hardly farther (by no more than twice the ``error``
    of log scale), or another one is as far as the tolerance, the ``named`` factor
    decides if it is one of them; without it such a scale stays null or nearest.
    """
    logs = ", ".join(f"'{c}', array({', '.join(f"named_struct('l', {math.log(f)!r}D, 'f', cast('{f}' as decimal(24,12)))" for f in factors)})" for c, factors in CONVERSIONS.items())
    at = lambda b, i: F.get(b, F.lit(i))
    slack = 2 * (F.lit(error) if isinstance(error, float) else error)

    def choose(b: Column) -> Column:
        clear = at(b, 1).isNull() | (at(b, 1)["d"] - at(b, 0)["d"] > slack)
        alone = F.when((at(b, 0)["d"] <= tolerance) & clear, at(b, 0)["f"])
        return alone if named is None else F.coalesce(F.get(F.filter(b, lambda x: (x["d"] <= tolerance) & (x["f"] == named)), F.lit(0))["f"], alone)

    known = F.element_at(F.expr(f"map({logs})"), target)
    return let(F.array_sort(F.transform(known, lambda x: F.struct(F.abs(F.log(scale) - x["l"]).alias("d"), x["f"].alias("f")))), choose)


def named_factor(source: Column, common: Column) -> Column:
    """The conversion that the source's name stands for, if its magnitude is ``common``; else null."""
    return F.when(F.element_at(unit_map(0), source) == common, F.element_at(unit_map(1), source))


def propagate(links: DataFrame, min_links: int = MIN_LINKS, tolerance: float = TOLERANCE) -> DataFrame:
    """Factors of all sources that reach a common unit over links that a known conversion explains.

    links: ``source``, ``target``, ``x``, ``y`` and ``kind`` (0: prices over
    stated contents, 1: prices of two spellings, 2: measures and stated contents).
    Result: ``source``, ``common``, ``est_factor``.  In each round the links to sources whose factor is known are
    turned into links to their common unit and pooled, kind by kind; a source
    takes its surest estimate.  A median whose offset or spread shows more than
    one scale is none.  Rounds go on until no source is added; the graph has a
    node for each spelling of a unit, so it doesn't grow with the rows.
    """
    spark, bias = links.sparkSession, cut(known_bias(links.filter("kind = 0"), min_links), "bias").df
    common = F.explode(F.array(*(F.lit(c) for c in CONVERSIONS)))
    known = spark.range(1).select(common.alias("source")).select("source", F.col("source").alias("common"), F.lit(1).cast("decimal(24,12)").alias("est_factor"))
    best, total = Window.partitionBy("source").orderBy("error", "kind", "target"), Window.partitionBy("source", "kind")
    while True:
        d = links.alias("l").join(known.alias("k"), F.col("l.target") == F.col("k.source")).select(
            F.col("l.source").alias("source"), F.col("k.common").alias("target"), "kind", "x", (F.col("y") * F.col("k.est_factor").cast("double")).alias("y")
        )
        s = pair_scales(d.join(known.select("source"), "source", "left_anti"), ("source", "target", "kind")).withColumn("_all", F.sum("n").over(total))
        s = s.filter((F.col("n") >= min_links) & (F.col("n") >= SHARE * F.col("_all")) & (F.col("spread") < SPREAD)).join(bias, "target", "left")
        # list prices over contents err one way, prices of two shops don't
        scale = F.col("scale") / F.exp(F.when(F.col("kind") == 0, F.coalesce("bias", F.lit(0.0))).otherwise(0.0))
        # standard error of a median: 1.253 sigma / sqrt(n), where sigma is 1.4826 of the median deviation
        s = s.select("source", "target", "kind", scale.alias("scale"), (1.858 * F.col("spread") / F.sqrt("n")).alias("error"))
        s = s.withColumn("est_factor", snap(F.col("scale"), F.col("target"), tolerance, F.col("error"), named_factor(F.col("source"), F.col("target"))))
        s = s.filter("est_factor is not null").withColumn("_r", F.row_number().over(best)).filter("_r = 1")
        fresh = cut(s.select("source", F.col("target").alias("common"), "est_factor"), "reach")
        if fresh.df.isEmpty():
            fresh.drop()
            return known
        known = known.unionByName(fresh.df)


def unit_sources(listings: DataFrame) -> DataFrame:
    """Listings with ``_stem`` and ``_quantity`` of the unit that their unit price is per."""
    told = F.when(F.col("unidad_medida").isNull(), price_phrase(F.col("name"))).otherwise(F.col("unidad_medida"))
    return listings.withColumn("_told", unit_phrase(told)).withColumn("_stem", F.col("_told.stem")).withColumn("_quantity", F.col("_told.quantity")).drop("_told")


def price_links(priced: DataFrame) -> DataFrame:
    """Links between unit spellings and common units within each listing: its unit price against price over stated contents."""
    # shops state the unit price of the full price, not of the offer
    price = F.coalesce(*(F.when(F.col(c) > 0, F.col(c)) for c in ("precio_normal", "precio_internet", "precio_oferta", "precio_tarjeta"))).cast("double")
    d = priced.filter(F.col("_stem").isNotNull() & (F.col("_quantity") > 0)).select(
        "_stem", price.alias("p"), (F.col("precio_unitario") / F.col("_quantity").cast("double")).alias("y"), stated(F.col("name")).alias("_s")
    )
    pieces = F.get(F.filter("_s", lambda r: (r["common"] == "un") & (r["amount"] > 0)), F.lit(0))["amount"]
    d = d.select("_stem", "p", "y", F.coalesce(pieces, F.lit(1)).alias("pieces"), F.explode("_s").alias("r"))
    # a pack of several pieces holds the contents of each
    held = F.col("r.amount").cast("double") * F.when(F.col("r.common") == "un", 1.0).otherwise(F.col("pieces").cast("double"))
    # a price per source unit is factor times the price per common unit
    return d.select(F.col("_stem").alias("source"), F.col("r.common").alias("target"), F.try_divide("p", held).alias("x"), "y")


def entity_links(priced: DataFrame, entities: DataFrame) -> DataFrame:
    """Links between unit spellings within each entity: unit prices of its listings at different shops.

    entities: ``entity``, ``silver_row_id``.  An entity has one mean log price
    for each spelling, however many listings it has, and each spelling is linked
    with the entity's most common one in both directions: linear in spellings.
    """
    p = priced.filter(F.col("_stem").isNotNull() & (F.col("_quantity") > 0)).select(
        "silver_row_id", "_stem", F.log(F.col("precio_unitario") / F.col("_quantity").cast("double")).alias("lp")
    )
    members = entities.filter("entity is not null and silver_row_id is not null").distinct()
    per = p.join(members, "silver_row_id").groupBy("entity", "_stem").agg(F.avg("lp").alias("lp"))
    per = cut(per.join(p.groupBy("_stem").agg(F.count(F.lit(1)).alias("n")), "_stem"), "entity-prices").df
    hub = per.groupBy("entity").agg(F.max(F.struct("n", "_stem", "lp")).alias("h"))
    d = per.join(hub, "entity").filter(F.col("_stem") != F.col("h._stem"))
    way = lambda a, la, b, lb: F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.exp(lb).alias("x"), F.exp(la).alias("y"))
    return d.select(F.inline(F.array(way("_stem", "lp", "h._stem", "h.lp"), way("h._stem", "h.lp", "_stem", "lp"))))


def measure_links(products: DataFrame, units: DataFrame) -> DataFrame:
    """Links between unit ids and common units within each product: contents in its name against its recorded measure."""
    d = products.filter("valor_medida > 0").join(units, "id_unidad").select("nombre_unidad", F.col("valor_medida").cast("double").alias("x"), F.explode(stated(F.col("nombre_producto"))).alias("r"))
    return d.select(F.lower("nombre_unidad").alias("source"), F.col("r.common").alias("target"), "x", F.col("r.amount").cast("double").alias("y"))


def known_bias(links: DataFrame, min_links: int = MIN_LINKS) -> DataFrame:
    """``target``, ``bias``: median log error of the links of known spellings, by common unit (one row for each)."""
    ok = links.filter("x > 0 and y > 0").filter(F.element_at(unit_map(0), F.col("source")) == F.col("target"))
    error = F.log(F.col("y") / F.col("x") / F.element_at(unit_map(1), F.col("source")).cast("double"))
    return ok.groupBy("target").agg(F.percentile_approx(error, 0.5, 1000).alias("bias"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_links).drop("n")


def source_factors(links: DataFrame, sources: DataFrame, min_links: int = MIN_LINKS, tolerance: float = TOLERANCE) -> DataFrame:
    """Factors of all ``sources`` that can be told: ``source``, ``common``, ``est_factor``.

    links: see propagate.  Linked sources have their estimated, propagated and
    snapped factor or none; those with fewer than FEW_LINKS links that no
    estimate reaches have the conversion that their name stands for.
    """
    written = cut(links, "links").df
    told = propagate(written, min_links, tolerance)
    many = written.filter("x > 0 and y > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FEW_LINKS)
    few = sources.distinct().join(many, "source", "left_anti").join(told.select("source"), "source", "left_anti")
    few = few.select("source", F.element_at(unit_map(0), F.col("source")).alias("common"), F.element_at(unit_map(1), F.col("source")).alias("est_factor"))
    return told.unionByName(few.filter("common is not null"))


def resolve(rows: DataFrame, source: str, factors: DataFrame) -> DataFrame:
    """Add ``unidad_comun`` and ``_factor`` of the row's source; words that name no unit are vetoed, however steady their links (a pallet of cement looks like a kilogram)."""
    d = rows.join(factors.withColumnRenamed("source", source), source, "left")
    vetoed = F.coalesce(F.col(source).isin(*NO_UNITS), F.lit(False))
    return d.withColumn("unidad_comun", F.when(~vetoed, F.col("common"))).withColumn("_factor", F.when(~vetoed, F.col("est_factor"))).drop("common", "est_factor")


def div_half_up(num: Column, den: Column) -> Column:
    """num / den in whole numbers, halves up, without binary rounding (num whole, den with up to 12 decimals)."""
    big = "decimal(38,0)"
    d = (den.cast("decimal(26,12)") * F.lit(10**12).cast("decimal(13,0)")).cast(big)
    n = (num.cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)")).cast(big)
    return F.call_function("div", n * 2 + d, d * 2)


def harmonise(listings: DataFrame, products: DataFrame, units: DataFrame, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(unit prices per common unit, measures in the common unit), from one graph of all spellings in both tables.

    Prices: silver_row_id, unidad_comun, valor in whole pesos.  Measures:
    id_producto, unidad_comun, valor in millionths.  entities: ``entity``,
    ``silver_row_id`` of listings known to be one article; without them spellings
    are linked by stated contents only.  Listings without a positive unit price,
    and rows whose unit can't be told, are left out; where a product's unit or
    value is missing, weight or else volume is read from its name.  Repeated rows
    give repeated results.  See TESTDATA.md, p6_found.
    """
    priced = unit_sources(listings.filter("precio_unitario > 0"))
    priced = cut(priced.select("silver_row_id", "name", "precio_normal", "precio_internet", "precio_oferta", "precio_tarjeta", "precio_unitario", "_stem", "_quantity"), "priced").df
    dims = units.select("id_unidad", "nombre_unidad")
    links = price_links(priced).withColumn("kind", F.lit(0)).unionByName(measure_links(products, dims).withColumn("kind", F.lit(2)))
    if entities is not None:
        links = links.unionByName(entity_links(priced, entities).withColumn("kind", F.lit(1)))
    stems = priced.select(F.col("_stem").alias("source")).unionByName(dims.select(F.lower("nombre_unidad").alias("source"))).filter("source is not null")
    factors = cut(source_factors(links, stems), "factors").df
    return _prices(priced, factors), _measures(products, dims, factors)


def harmonise_prices(listings: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """The prices of harmonise(), without a table of products."""
    spark = listings.sparkSession
    none = spark.createDataFrame([], "id_producto int, nombre_producto string, id_unidad int, valor_medida decimal(10,2)")
    return harmonise(listings, none, spark.createDataFrame([], "id_unidad int, nombre_unidad string"), entities)[0]


def harmonise_measures(products: DataFrame, units: DataFrame) -> DataFrame:
    """The measures of harmonise(), without listings."""
    prices = ", ".join(f"{c} bigint" for c in ("precio_normal", "precio_internet", "precio_oferta", "precio_tarjeta", "precio_unitario"))
    return harmonise(products.sparkSession.createDataFrame([], f"silver_row_id string, name string, unidad_medida string, {prices}"), products, units)[1]


def _prices(priced: DataFrame, factors: DataFrame) -> DataFrame:
    done = resolve(priced, "_stem", factors)
    per = (F.col("_quantity") * F.col("_factor")).cast("decimal(26,12)")
    return done.filter(F.col("unidad_comun").isNotNull() & (per > 0)).select("silver_row_id", "unidad_comun", div_half_up(F.col("precio_unitario"), per).alias("valor"))


def _measures(products: DataFrame, dims: DataFrame, factors: DataFrame) -> DataFrame:
    d = products.join(dims, "id_unidad", "left").withColumn("_unit", F.lower("nombre_unidad"))
    d = resolve(d, "_unit", factors)
    given = F.col("valor_medida").isNotNull() & F.col("_factor").isNotNull()
    d = d.withColumn("_named", F.when(~given, F.get(stated(F.col("nombre_producto"), ("kg", "lt")), F.lit(0))))
    amount = F.when(given, F.col("valor_medida") * F.col("_factor")).otherwise(F.col("_named.amount"))
    common = F.when(given, F.col("unidad_comun")).otherwise(F.col("_named.common"))
    valor = F.round(amount.cast("decimal(28,12)") * F.lit(10**6).cast("decimal(7,0)"), 0).cast("bigint")
    return d.select("id_producto", common.alias("unidad_comun"), valor.alias("valor")).filter("unidad_comun is not null and valor is not null")
