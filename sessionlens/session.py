"""Spark session helper. Every setting here is a default a cluster may override."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    # Timestamps are instants; every local-time rule converts explicitly.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Files keep bounds of instants only in this form, and filters on them skip what lies outside.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark 4.1 lets a union pass on its inputs' partitioning; with adaptive execution one key was seen in two partitions then,
    # and a group came out as two rows.
    "spark.sql.unionOutputPartitioning": "false",
}


def get_spark(app: str = "sessionlens", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or join) a session. ``conf`` keys use ``__`` for dots: ``spark__ui__enabled="false"``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names. A temporary one stands in only where everything runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^-]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set: {master} needs a folder that all executors and the driver share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Folders of the staging blocks that are open, the innermost last.
_SCOPE: ContextVar[tuple[str, ...]] = ContextVar("staging folders", default=())


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Results staged inside share a folder, which goes when the block ends, also by an error.

    For work whose results are durable by then: a pass, a batch of a stream. What a query returns unread must be staged outside,
    or inside with ``outer=True``.
    """
    folder = f"{checkpoint_dir(spark)}/staging-{uuid.uuid4().hex}"
    token = _SCOPE.set((*_SCOPE.get(), folder))
    try:
        yield
    finally:
        _SCOPE.reset(token)
        delete(spark, folder)


def stage(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write a result that several steps read into the shared checkpoint folder and read it back.

    Unlike a cached block, the files survive the loss of an executor. ``outer`` leaves them to what is around the staging block.
    """
    spark = df.sparkSession
    scopes = _SCOPE.get()[: -1 if outer else None]
    path = f"{scopes[-1] if scopes else checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
