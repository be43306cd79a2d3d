"""Queries of the training-data problems tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.groups import hash_to_min, star_edges
from cotejo.llm.listings import all_pairs, same_item_groups
from cotejo.llm.mixing import mix
from cotejo.llm.packing import fill_report, pack, window_shares
from cotejo.llm.reading import reading_levels
from cotejo.llm.sql import SQL  # noqa: F401
from cotejo.llm.survivor import filled, newest, survivors, usable_brand, usable_image
from cotejo.llm.tokens import with_token_counts
from cotejo.sources.tables import table

PRICES = ("precio_normal", "precio_internet", "precio_oferta", "precio_tarjeta")


def _row_id(x):
    return F.nullif(F.lower(F.trim(x)), F.lit(""))


def _same_items(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["name", "brand", *PRICES]
    rows = newest(table(spark, sf, "bronze_product").select("silver_row_id", "fecha_ultima_revision", *fields), "silver_row_id", "fecha_ultima_revision", fields)
    price = F.coalesce(*(F.when(F.col(p) > 0, F.col(p)) for p in ("precio_normal", "precio_internet", "precio_oferta", "precio_tarjeta")))
    return same_item_groups(rows, "silver_row_id", "name", "brand", price)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of listings of the same article."""
    return all_pairs(_same_items(spark, sf), "left_row_id", "right_row_id")


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each listing that shares its article, with its group and the number of its partners."""
    g = _same_items(spark, sf)
    n = g.groupBy("group_id").agg((F.count(F.lit(1)) - 1).alias("partners"))
    return g.join(n, "group_id").select(F.col("member").alias("silver_row_id"), F.col("group_id").alias("group_row_id"), "partners")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Group identifier of every listing that decisions or entities link with another one."""
    d = table(spark, sf, "gold_review_llm_decisions").filter("auto_action = 'accept'")
    judged = d.select(_row_id(F.col("left_product.silver_row_id")).alias("a"), _row_id(F.col("right_product.silver_row_id")).alias("b"))
    v = table(spark, sf, "gold_products").select("gold_product_id", F.explode("store_variants.silver_row_id").alias("m"))
    edges = judged.unionByName(star_edges(v.select("gold_product_id", _row_id(F.col("m")).alias("m")), "gold_product_id", "m"))
    return hash_to_min(edges).select(F.col("member").alias("silver_row_id"), F.col("group_id").alias("group_row_id"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Surviving record of each entity, field by field."""
    gold = table(spark, sf, "gold_products").select("gold_product_id", F.explode_outer("store_variants.silver_row_id").alias("silver_row_id"))
    fields = ["store", "brand", "image_url", "unidad_medida", "sku_store", *PRICES]
    rows = newest(table(spark, sf, "bronze_product").select("silver_row_id", "fecha_ultima_revision", *fields), "silver_row_id", "fecha_ultima_revision", fields)
    ranks = table(spark, sf, "store_rank").filter("store is not null").groupBy("store").agg(F.min("trust_rank").alias("trust_rank"))
    price = F.greatest(*(F.coalesce(p, F.lit(0)) for p in PRICES)) > 0
    rows = rows.join(ranks, "store", "left").select(
        "silver_row_id",
        (-F.unix_date(F.try_to_date("fecha_ultima_revision"))).alias("age"),
        "trust_rank",
        usable_brand(F.col("brand")).alias("brand_ok"),
        usable_image(F.col("image_url")).alias("image_ok"),
        filled(F.col("unidad_medida")).alias("unit_ok"),
        filled(F.col("sku_store")).alias("sku_ok"),
        price.alias("price_ok"),
    )
    c = gold.join(rows, "silver_row_id", "left")
    best = survivors(
        c, "gold_product_id", "silver_row_id", [F.col("age"), F.col("trust_rank")], {"brand": F.col("brand_ok"), "image": F.col("image_ok")},
        [F.col(x) for x in ("brand_ok", "image_ok", "unit_ok", "sku_ok", "price_ok")],
    )
    return best.select("gold_product_id", F.col("base").alias("base_row_id"), F.col("brand").alias("brand_row_id"), F.col("image").alias("image_row_id"))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return with_token_counts(table(spark, sf, "documents"), "text", ["doc_id", "source"])


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every message, whole or cut where it must be, in containers of every capacity."""
    return pack(_sizes(spark, sf), table(spark, sf, "pack_capacity")).withColumnRenamed("item_id", "doc_id")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and unused space for each capacity."""
    caps = table(spark, sf, "pack_capacity")
    return fill_report(pack(_sizes(spark, sf), caps), caps)


def p8_windows(spark: SparkSession, sf: str) -> DataFrame:
    """How far the windows of each capacity keep to the sources' token shares."""
    caps = table(spark, sf, "pack_capacity")
    return window_shares(pack(_sizes(spark, sf), caps), caps)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How often every message appears in the mix."""
    return mix(_sizes(spark, sf), table(spark, sf, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every source."""
    return mix(_sizes(spark, sf), table(spark, sf, "mix_target"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_sample")).select("doc_id", "nivel")


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, mean difficulty and level counts of each source."""
    docs = table(spark, sf, "documents")
    d = reading_levels(docs, table(spark, sf, "reading_sample")).join(docs.select("doc_id", "source"), "doc_id")
    levels = [F.count_if(F.col("nivel") == k).alias(f"level_{k}") for k in (1, 2, 3)]
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("messages"), F.round(F.avg("difficulty"), 3).alias("difficulty"), *levels)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p8_windows": p8_windows,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_profile": p10_profile,
}
