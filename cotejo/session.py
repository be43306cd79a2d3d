"""Session defaults and the shared folder in which lineage is cut.

Long pipelines write their intermediate tables as Parquet below the folder that
the cluster names in ``spark.checkpoint.dir``; any executor can read them after
another one is lost.  Only where that setting is absent (tests, laptops) a
folder of our own is used.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def build_session(app: str = "cotejo", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the engine expects (UTC, AQE)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COTEJO_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="cotejo-")
        _own[app] = f"{base.rstrip('/')}/cotejo-{app}"
        atexit.register(_forget, spark, _own[app])
    return _own[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the JVM may be gone already
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that cut() wrote, on whatever file system it lives."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Cut:
    """A written intermediate table: ``.df`` reads it, ``.drop()`` deletes it."""

    def __init__(self, df: DataFrame, name: str, options: dict[str, str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.options(**(options or {})).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def cut(df: DataFrame, name: str, options: dict[str, str] | None = None) -> Cut:
    """Write ``df`` into the shared folder and continue from the written copy."""
    return Cut(df, name, options)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Plans that run inside hand Python at most so many rows at a time: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)
