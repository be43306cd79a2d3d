"""Structured Streaming versions of the incremental jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.operators.store import upsert
from cotejo.session import drop_path
from cotejo.sources.sinks import read_version, write_version


def price_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Captures arriving as Parquet files below ``path``; without ``files_per_batch`` a run takes what is there as one batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def first_captures(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Captures without those that were loaded twice: state is dropped behind the watermark."""
    return stream.withWatermark("fecha_captura", delay).dropDuplicatesWithinWatermark(["id_producto_maestro", "id_retailer", "fecha_captura", "precio_clp"])


def calls_per_window(stream: DataFrame, who: str, time: str, width: str = "1 minute", limit: int = 5, delay: str = "5 minutes") -> DataFrame:
    """Windows in which someone called more often than ``limit`` times."""
    counted = stream.withWatermark(time, delay).groupBy(F.col(who), F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return counted.filter(F.col("calls") > limit).select(who, F.col("w.start").alias("start"), "calls")


KEYS = ["id_producto_maestro", "id_retailer"]


def run_changes(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process what is there; read_changes() then gives each capture whose whole price differs from the one before it.

    State is the last capture of each product and retailer.  A series whose new
    captures all come after it goes on from there.  One with a capture that was
    loaded late is worked out anew from its captures and replaces what was said
    before (``reset``), since later captures may have become changes or ceased to
    be.  A batch that is repeated after a failure overwrites its own folders, so
    nothing is appended twice; of the state only two versions are kept.
    """
    spark = stream.sparkSession
    order = ["fecha_captura", "id_precio"]

    def batch(df: DataFrame, n: int) -> None:
        w = Window.partitionBy(*KEYS).orderBy(*order)
        rows = df.filter("precio_clp > 0").select(*KEYS, *order, F.rint(F.col("precio_clp").cast("double")).alias("precio"))
        rows.write.mode("overwrite").parquet(f"{target}/captures/n={n}")
        new = spark.read.schema(rows.schema).parquet(f"{target}/captures/n={n}")
        last = spark.read.schema(rows.schema).parquet(f"{target}/state/n={n - 1}") if n else spark.createDataFrame([], rows.schema)
        first = new.groupBy(*KEYS).agg(F.min(F.struct(*order)).alias("_f"))
        late = first.join(last, KEYS).filter(F.col("_f") < F.struct(*order)).select(*KEYS)
        every = spark.read.schema(new.schema).parquet(*(f"{target}/captures/n={k}" for k in range(n + 1)))
        changed = lambda d: d.withColumn("_before", F.lag("precio").over(w)).filter("_before is null or _before <> precio")
        again = changed(every.join(late, KEYS, "left_semi")).withColumn("reset", F.lit(True))
        going = last.withColumn("_old", F.lit(True)).join(first.select(*KEYS), KEYS, "left_semi").unionByName(new.withColumn("_old", F.lit(False))).join(late, KEYS, "left_anti")
        on_time = changed(going).filter("not _old").withColumn("reset", F.lit(False))
        cols = [*rows.columns, "reset"]
        again.select(*cols).unionByName(on_time.select(*cols)).write.mode("overwrite").parquet(f"{target}/changes/n={n}")
        top = F.max(F.struct(*order, "precio")).alias("t")
        last.unionByName(new).groupBy(*KEYS).agg(top).select(*KEYS, "t.*").write.mode("overwrite").parquet(f"{target}/state/n={n}")
        if n > 1:
            drop_path(spark, f"{target}/state/n={n - 2}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_changes(spark: SparkSession, target: str) -> DataFrame:
    """The changes that stand: of each series what was said since it was last worked out anew."""
    d = spark.read.parquet(f"{target}/changes")
    since = d.filter("reset").groupBy(*KEYS).agg(F.max("n").alias("_since"))
    return d.join(since, KEYS, "left").filter(F.col("_since").isNull() | (F.col("n") >= F.col("_since"))).drop("_since", "reset", "n")


def run_refresh(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: str) -> None:
    """Daily refresh: each batch of listings goes into the versioned table at ``target``; for each key the row with the greatest ``order`` stays.

    Readers see whole versions only (see write_version); a repeated batch changes nothing.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, n: int) -> None:
        old = read_version(spark, target) if n else df.limit(0)
        write_version(upsert(old, df, keys, order), target)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
