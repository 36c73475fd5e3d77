"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "stemma", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling switched on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is
    made only in local mode, where driver and tasks share one disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="stemma-"))
    return context.getCheckpointDir().rstrip("/")


def compile_small_methods(spark: SparkSession) -> None:
    """Let Spark fuse operators only where the Java method stays below 8,000 bytes.

    HotSpot does not compile longer methods, so a fused stage with many rules
    runs several times slower than its operators one by one.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


@contextmanager
def all_partitions(spark: SparkSession) -> Iterator[None]:
    """Run the jobs inside on as many tasks as there are shuffle partitions.

    Partitions are merged by their bytes. Where few small rows give many pairs
    that makes a handful of long tasks, and most cores wait.
    """
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    Used where a result feeds several later joins, so that neither a lost
    executor nor a second consumer makes Spark compute it again. The written
    table also has a known size, so the planner broadcasts it only when it is
    small enough. The tables of an application are deleted when it ends.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staging_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    _delete_at_end(path)
    return path


@cache
def _delete_at_end(path: str) -> None:
    context = SparkSession.active().sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
