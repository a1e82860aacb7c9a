"""Following transcripts as they grow.

* Append-only segments are a file stream: each batch's session states are merged into a table.
* Files that grow in place are not re-read by any file source: they are followed by scheduled
  :meth:`SessionIndex.reconcile` passes, which also prune deletions and catch anything a stream missed.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlens import constants as K
from sessionlens.operators import sessions as S
from sessionlens.operators.merge import merge_states
from sessionlens.plans.reconcile import SessionIndex
from sessionlens.session import delete, stage, staging
from sessionlens.sources import sinks


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    return sinks.read_table(spark, path, schema)


def follow_segments(records: DataFrame, path: str, checkpoint: str, buckets: int = sinks.DEFAULT_BUCKETS, **trigger) -> StreamingQuery:
    """Merge a stream of records into the session states at ``path``, each record exactly once.

    A stored state says which line it has seen last, so records up to it are left out: a batch that is replayed after a failure changes
    nothing, and records that come under a new checkpoint are told from those that were merged before it by their numbers alone.
    Records of a session must come in order of ``seq``, as lines of a growing transcript do.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        with staging(batch.sparkSession):
            _merge(batch)

    def _merge(batch: DataFrame) -> None:
        spark = batch.sparkSession
        bucket = sinks.bucket_of(F.col("session_id"), buckets)
        columns = ["session_id", *S.STATE_COLUMNS]
        # Staged: the batch is read several times, and a source may not give it twice.
        records = stage(batch.withColumn("bucket", bucket), "batch")
        touched = stage(records.select("bucket").distinct(), "touched")
        schema = S.session_state(records, ("session_id",)).select(*columns, F.lit(0).alias("bucket")).schema
        # At most one row per bucket of the layout.
        near = _stored(spark, path, schema).join(F.broadcast(touched), "bucket", "left_semi")
        seen = near.select("session_id", F.col("last_seq").alias("_seen"))
        new = records.drop("bucket").join(seen, "session_id", "left").where(F.col("_seen").isNull() | (F.col("seq") > F.col("_seen"))).drop("_seen")
        tail = stage(S.session_state(new, ("session_id",)), "tail")
        merged = merge_states(near, tail).select(*columns, bucket.alias("bucket"))
        sinks.overwrite_buckets(merged, path, touched)

    return (
        records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def follow_index(records: DataFrame, index: SessionIndex, now, checkpoint: str, owner=None, **trigger) -> StreamingQuery:
    """Append a stream of records to an index: sessions, chunks, postings and vocabulary of a batch become current together, so what
    was said can be found. A batch that comes again, also under a new checkpoint, changes nothing. ``now`` is called for each batch."""

    def append(batch: DataFrame, batch_id: int) -> None:
        index.add_records(batch, now(), owner)

    return (
        records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def running_sessions(records: DataFrame, late: str | None = None) -> DataFrame:
    """Streaming session state: bounds, counts and latest titles, for update mode.

    The aggregates commute, so late records merge. ``late`` adds a watermark, which only bounds what
    the engine keeps for other operators downstream.
    """
    stream = records.withWatermark("ts", late) if late else records
    return S.session_state(stream, ("session_id",))


def write_updates(updates: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each batch of updated rows under its batch id; rewriting a batch is harmless."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        updates.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def latest_updates(spark: SparkSession, path: str, key: str = "session_id") -> DataFrame:
    """The newest version of each row written by :func:`write_updates`."""
    rows = spark.read.parquet(path)
    newest = W.partitionBy(key).orderBy(F.col("batch").desc())
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n", "batch")


def pending_changes(changed: DataFrame, before: DataFrame | None, at: float) -> DataFrame:
    """``session_id, size, mtime, first_seen, last_seen`` of files that wait to be read, one look after another.

    ``changed`` are the files (session_id, size, mtime) that differ from what is stored now, ``before`` what waited at the last look."""
    rows = changed.select("session_id", "size", "mtime")
    if before is None:
        return rows.withColumns({"first_seen": F.lit(at), "last_seen": F.lit(at)})
    old = before.select("session_id", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), "first_seen", "last_seen")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("last_seen").isNotNull()
    return rows.join(old, "session_id", "left").select(
        "session_id", "size", "mtime", F.coalesce("first_seen", F.lit(at)).alias("first_seen"), F.when(same, F.col("last_seen")).otherwise(F.lit(at)).alias("last_seen"))


def follow_folder(
    index: SessionIndex, root: str, now, every_seconds: float = 0.5, passes: int | None = None,
    settle_seconds: float | None = None, max_wait_seconds: float = K.MAX_WAIT_SECONDS, clock=time.time,
) -> None:
    """Repeat passes over a folder of growing files. Each pass diffs the snapshot, so lost change
    notices cannot be missed, and passes are incremental.

    ``now`` is called for the completion time of each pass. With ``settle_seconds`` a changed file is read once it was quiet for longer
    than that or has waited longer than ``max_wait_seconds``, by the rules of :func:`changes.debounce`; passes without a ready file write nothing.
    """
    done, waiting, looks = 0, None, []
    while passes is None or done < passes:
        if settle_seconds is None:
            index.reconcile(root, now())
        else:
            at = clock()
            with staging(index.spark):
                changed = index.plan(root).where(F.col("plan") != "skip")
                waiting = stage(pending_changes(changed, waiting, at), "waiting", outer=True)
            looks.append(waiting)
            is_ready = (F.lit(at) - F.col("last_seen") > settle_seconds) | (F.lit(at) - F.col("first_seen") > max_wait_seconds)
            ready = waiting.where(is_ready)
            if not ready.isEmpty():
                index.reconcile(root, now(), only=ready)
            # Of the looks before only the last one is read again.
            for old in looks[:-1]:
                for path in {f.rsplit("/", 1)[0] for f in old.inputFiles()[:1]}:
                    delete(index.spark, path)
            del looks[:-1]
        done += 1
        if passes is None or done < passes:
            time.sleep(every_seconds)
