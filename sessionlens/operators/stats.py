"""Index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens import constants as K


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kind").agg(F.count("*").alias("n"))


def chunks_by_kind(chunks: DataFrame) -> DataFrame:
    """One row: a map from kind to chunk count, and the total."""
    return chunk_counts(chunks).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
    )


def kinds_pivot(chunks: DataFrame) -> DataFrame:
    """Chunk counts per session, one column per kind."""
    names = {1: "title", 2: "folder", 3: "last_prompt", 4: "user_prompt", 5: "assistant_text"}
    counts = [F.count_if(F.col("kind") == code).alias(name) for code, name in names.items()]
    return chunks.groupBy("session_id").agg(F.count("*").alias("chunks"), *counts)


def index_statistics(sessions: DataFrame, chunks: DataFrame, last_reconcile: DataFrame | None = None) -> DataFrame:
    """One row of counters; zeros when the tables are empty."""
    counters = sessions.agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"),
        F.count_if(F.col("folder_source") == K.FOLDER_UNKNOWN).alias("unknown_folders"),
        F.max("last_activity").alias("newest_activity"),
    )
    totals = chunks_by_kind(chunks)
    row = counters.select(
        "*", totals.select("chunks").scalar().alias("chunks"), totals.select("by_kind").scalar().alias("by_kind")
    )
    if last_reconcile is None:
        return row.withColumn("last_reconcile", F.lit(None).cast("timestamp"))
    return row.withColumn("last_reconcile", last_reconcile.agg(F.max("completed_at")).scalar())
