"""Spark helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.session import stage


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out by ``columns`` to the session's number of shuffle partitions, which small rows of costly work need too: adaptive
    execution joins partitions by their bytes alone."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def whole_text(column: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected links ``(a, b)``: one row ``(node, component)`` per node, the smallest node's name.

    Every round draws a random rank per node and merges each node into its lowest-ranked neighbour, which leaves a constant
    share of the nodes; a hub with any number of links is one pre-aggregated minimum. The rounds' maps are joined afterwards.
    Null ends and loops link nothing; nodes without links are not returned.
    """
    spark = edges.sparkSession
    links = stage(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    maps = []
    while links.limit(1).count():
        def rank(c: str, salt: int = len(maps)) -> Column:
            return F.struct(F.xxhash64(F.lit(salt), c).alias("rank"), F.col(c).alias("name"))

        ends = links.select(F.col("a").alias("node"), rank("b").alias("r")).unionByName(links.select(F.col("b").alias("node"), rank("a").alias("r")))
        least = ends.groupBy("node").agg(F.min("r").alias("r"))
        step = stage(least.select("node", F.least("r", rank("node"))["name"].alias("target")), f"{name}-map")
        maps.append(step)
        links = stage(
            links.join(step.withColumnRenamed("node", "a"), "a").select(F.col("target").alias("x"), "b")
            .join(step.select(F.col("node").alias("b"), F.col("target").alias("y")), "b")
            .where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-links")
    if not maps:
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], "node long, component long").select(F.col("node").cast(kind), F.col("component").cast(kind))
    full = maps[-1]
    for step in reversed(maps[:-1]):
        later = full.select(F.col("node").alias("target"), F.col("target").alias("further"))
        full = step.join(later, "target", "left").select("node", F.coalesce("further", "target").alias("target"))
    full = stage(full, f"{name}-full")
    least = full.groupBy("target").agg(F.min("node").alias("component"))
    return full.join(least, "target").select("node", F.least("node", "component").alias("component"))
