"""Store feeds: JSON envelopes with a products array, and category hints."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.catalog import canonical_url

PRODUCT = (
    "name string, brand string, sku_store string, product_url string, precio_normal bigint, precio_internet bigint, precio_oferta bigint, precio_tarjeta bigint, precio_unitario bigint, "
    "unidad_medida string, precio_unitario_fuente string, image_url string, fecha_ultima_revision string, disponibilidad boolean"
)
# fixed values: keys that every product must carry, null allowed
REQUIRED = ("name", "brand", "sku_store", "product_url", "precio_normal", "precio_internet", "precio_oferta", "precio_tarjeta", "precio_unitario", "unidad_medida", "image_url")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_feeds(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """All products of all stores with ``store``, ``pos`` and ``reject_reason`` (null: accepted).

    paths: store -> folder or file of JSON envelopes, one object each, in the
    stores' order (``store_order``).  A missing path is a warning; text that is no
    envelope with a products array is an error when the rows are read.  Missing
    keys are told from nulls on the raw JSON of each element; reasons are
    not_object, missing_keys and blank_url, the first that applies.
    """
    feeds = None
    for order, (store, path) in enumerate(paths.items()):
        if not _exists(spark, path):
            warnings.warn(f"no feed of {store}: {path}", stacklevel=2)
            continue
        products = F.coalesce(F.from_json("value", "products array<string>")["products"], F.raise_error(F.lit(f"no products array in the feed of {store}")).cast("array<string>"))
        text = spark.read.text(path, wholetext=True).select(F.lit(store).alias("store"), F.lit(order).alias("store_order"), F.posexplode(products).alias("pos", "raw"))
        feeds = text if feeds is None else feeds.unionByName(text)
    if feeds is None:
        return spark.createDataFrame([], f"store string, store_order int, pos int, {PRODUCT}, reject_reason string")
    keys = F.json_object_keys("raw")
    d = feeds.withColumn("p", F.from_json("raw", PRODUCT))
    missing = F.size(F.array_except(F.array(*(F.lit(k) for k in REQUIRED)), keys)) > 0
    why = F.when(keys.isNull(), "not_object").when(missing, "missing_keys").when(F.coalesce(F.trim("p.product_url"), F.lit("")) == "", "blank_url")
    return d.select("store", "store_order", "pos", "p.*", why.alias("reject_reason"))


def read_hints(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``store``, ``product_url``, ``category_url`` of the category-hint files; both canonical, blanks dropped, the last of repeated keys (by file name and position) kept; a missing file gives none."""
    out = None
    for store, path in paths.items():
        body = F.from_json("value", "hints_by_product_url map<string,string>, hints map<string,string>")
        if not _exists(spark, path):
            continue
        pairs = F.posexplode(F.map_entries(F.coalesce(F.col("b.hints_by_product_url"), F.col("b.hints"))))
        d = spark.read.text(path, wholetext=True).select(body.alias("b"), F.input_file_name().alias("file")).select("file", pairs.alias("pos", "e")).select("file", "pos", F.col("e.key").alias("product_url"), F.col("e.value").alias("category_url")).withColumn("store", F.lit(store))
        out = d if out is None else out.unionByName(d)
    if out is None:
        return spark.createDataFrame([], "store string, product_url string, category_url string")
    out = out.select("store", "file", "pos", canonical_url(F.col("product_url")).alias("product_url"), canonical_url(F.col("category_url")).alias("category_url"))
    return out.filter("product_url <> '' and category_url <> ''").groupBy("store", "product_url").agg(F.max(F.struct("file", "pos", "category_url"))["category_url"].alias("category_url"))
