"""Sinks: versioned datasets with an atomic pointer, JSON envelopes and an append-only ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_version(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Write a new version below ``root`` and then point to it; readers see the old version or the new one, never a mixture."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{root}/{version}")
    jvm = spark.sparkContext._jvm
    tmp, fs = _fs(spark, f"{root}/CURRENT.{version}")
    out = fs.create(tmp, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, target, options)  # one step: the old pointer or the new one
    return version


def read_version(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """The version that the pointer names."""
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.format(fmt).load(f"{root}/{version}")


#: products in one envelope
ENVELOPE_ROWS = 5000


def write_envelopes(products: DataFrame, root: str) -> None:
    """Files of JSON envelopes {"total_products": n, "products": [...]} of at most ENVELOPE_ROWS products, below ``root``."""
    row = F.monotonically_increasing_id()
    d = products.withColumn("_p", F.shiftright(row, 33).cast("int")).withColumn("_c", F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / ENVELOPE_ROWS).cast("int"))
    body = F.to_json(F.struct(F.count(F.lit(1)).alias("total_products"), F.collect_list(F.struct(*products.columns)).alias("products")), {"ignoreNullFields": "false"})
    d.groupBy("_p", "_c").agg(body.alias("value")).write.partitionBy("_p", "_c").text(root)


def write_hints(hints: DataFrame, root: str) -> None:
    """Files of category hints {"hints_by_product_url": {url: url}}, keys sorted, one for each range of URLs; hints: product_url, category_url."""
    d = hints.groupBy("product_url").agg(F.max("category_url").alias("category_url")).repartitionByRange("product_url").withColumn("_p", F.spark_partition_id())
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("product_url", "category_url"))))
    d.groupBy("_p").agg(F.to_json(F.struct(entries.alias("hints_by_product_url"))).alias("value")).write.partitionBy("_p").text(root)


def append_ledger(decisions: DataFrame, root: str, day: str) -> str:
    """Append a batch of decisions and return its transaction id.

    The id is the fingerprint of the batch (of its rows in any order) and names
    the batch's folder, so a batch that is written again after a failure replaces
    itself; earlier ones are never touched.
    """
    cols = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(decisions.columns)]
    row = F.sha1(F.concat_ws("|", *cols))
    halves = [F.sum(F.conv(F.substring(row, k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in (1, 16)]
    mark = decisions.agg(F.sha1(F.concat_ws("|", F.lit(day), F.count(F.lit(1)).cast("string"), *halves)).alias("m")).first()["m"]
    tx = f"t{mark[:16]}"
    decisions.write.mode("overwrite").parquet(f"{root}/tx_date={day}/tx_id={tx}")
    return tx


def without_noise(lines: DataFrame, message: str, blocked: list[str]) -> DataFrame:
    """Log lines whose message holds none of the blocked texts (any letter case); a null message stays."""
    low, hit = F.lower(F.col(message)), F.lit(False)
    for b in blocked:
        hit = hit | F.contains(low, F.lit(b.lower()))
    return lines.filter(~F.coalesce(hit, F.lit(False)))


def write_gold(entities: DataFrame, review: DataFrame, metrics: DataFrame, root: str, dry_run: bool = False) -> dict[str, str]:
    """Versions of golden entities, review queue and metrics below ``root``; nothing is written in a dry run."""
    if dry_run:
        return {}
    return {name: write_version(df, f"{root}/{name}") for name, df in (("products", entities), ("review", review), ("metrics", metrics))}
