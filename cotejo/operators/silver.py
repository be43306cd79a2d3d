"""Normalised listings (silver): projection, validation, quality figures and category hints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions import catalog as fn
from cotejo.functions.text import clean_text

PRICES = ("precio_normal", "precio_internet", "precio_oferta", "precio_tarjeta")
# fixed values: fields that a normalised listing must fill
REQUIRED = ("silver_row_id", "store", "name_normalized", "brand_normalized", "product_url")


def with_category(rows: DataFrame, hints: DataFrame) -> DataFrame:
    """Add ``category_normalized`` and ``category_source`` (sidecar, product_url or empty).

    rows: ``store`` and a canonical ``product_url``.  hints: store, product_url,
    category_url, one row for each key (see read_hints).
    """
    d = rows.join(hints.select("store", "product_url", F.col("category_url").alias("_hint")), ["store", "product_url"], "left")
    hinted, own = F.nullif(fn.category_from_url(F.col("_hint")), F.lit("")), F.nullif(fn.category_from_url(F.col("product_url")), F.lit(""))
    d = d.withColumn("_a", F.when(F.col("_hint").isNotNull(), hinted)).withColumn("_b", own)
    source = F.when(F.col("_a").isNotNull(), "sidecar").when(F.col("_b").isNotNull(), "product_url").otherwise("empty")
    return d.withColumn("category_normalized", F.coalesce("_a", "_b", F.lit(""))).withColumn("category_source", source).drop("_hint", "_a", "_b")


def silver_rows(bronze: DataFrame, hints: DataFrame, generated_at: str, source_file: Column | None = None) -> DataFrame:
    """The 24 columns of a normalised listing from raw ones; null texts count as empty, a missing price stays null.

    ``silver_row_id`` is made of store, SKU and canonical URL, so an id in the
    input is not read.
    """
    text = lambda c: clean_text(F.coalesce(F.col(c), F.lit("")))
    d = bronze.select(
        "store", text("name").alias("name_original"), text("brand").alias("brand_original"), text("sku_store").alias("sku_store"), fn.canonical_url(F.col("product_url")).alias("product_url"),
        *PRICES, "precio_unitario", fn.normalize_unit(F.col("unidad_medida")).alias("unidad_medida"), "precio_unitario_fuente", "image_url",
    )
    d = with_category(d, hints).select(
        fn.short_id(F.col("store"), F.col("sku_store"), F.col("product_url")).alias("silver_row_id"), "store", "name_original", fn.normalize_name(F.col("name_original")).alias("name_normalized"),
        "brand_original", fn.normalize_brand(F.col("brand_original")).alias("brand_normalized"), "sku_store", "product_url", *PRICES, "precio_unitario", "unidad_medida", "precio_unitario_fuente", "image_url",
        fn.effective_price(*(F.col(p) for p in PRICES)).alias("effective_price"), "category_normalized", "category_source", fn.numeric_specs(F.col("name_original")).alias("numeric_specs"),
        F.col("store").alias("raw_source_store"), (source_file if source_file is not None else F.concat("store", F.lit("_products.json"))).alias("raw_source_file"), F.lit(generated_at).alias("generated_at_utc"),
    )
    flags = fn.quality_flags(*(F.col(c) for c in ("brand_normalized", "sku_store", "effective_price", "unidad_medida", "precio_unitario", "name_normalized")))
    return d.withColumn("quality_flags", flags)


def missing_fields(fields: Sequence[str] = REQUIRED) -> Column:
    """Array of the required fields that are null or blank."""
    return F.array_compact(F.array(*(F.when(F.coalesce(clean_text(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in fields)))


def checked_silver(rows: DataFrame, expected_stores: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """The rows sorted by id; a row without a required field, or in strict mode a missing store, is an error.

    The check runs inside the plan, so nothing is returned from a bad table.
    """
    bad = F.concat(F.lit("missing required fields: "), F.array_join(missing_fields(), ", "))
    ok = rows.withColumn("_ok", F.when(F.size(missing_fields()) > 0, F.raise_error(bad)).otherwise(F.lit(True))).filter("_ok").drop("_ok")
    if strict:
        have = {r[0] for r in rows.filter(F.col("store").isin(*expected_stores)).select("store").distinct().collect()}
        absent = [s for s in expected_stores if s not in have]
        if absent:
            raise ValueError(f"stores without rows: {', '.join(absent)}")
    return ok.orderBy("silver_row_id")


def silver_metrics(rows: DataFrame) -> DataFrame:
    """``store``, total and the four quality figures of every store."""
    return rows.groupBy("store").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count("effective_price").alias("with_effective_price"), F.count_if(F.col("brand_normalized") != fn.NO_BRAND).alias("with_brand_normalized"),
        F.count_if(F.size("numeric_specs") > 0).alias("with_numeric_specs"), F.count("precio_unitario").alias("with_unit_price"),
    )


def first_of_each_id(rows: DataFrame, ident: str, position: Sequence[str]) -> DataFrame:
    """The first row of each id by position; further columns decide between equal positions."""
    rest = [c for c in rows.columns if c not in (ident, *position)]
    comparable = [c for c in rest if rows.schema[c].dataType.typeName() != "map"]
    top = F.min_by(F.struct(*position, *rest), F.struct(*position, *comparable)).alias("_t")
    return rows.groupBy(ident).agg(top).select(ident, "_t.*")
