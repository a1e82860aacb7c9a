"""Snapshot comparison and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlens import constants as K
from sessionlens.operators.sessions import STATE_COLUMNS

DERIVED_KINDS = (K.KIND_TITLE, K.KIND_FOLDER, K.KIND_LAST_PROMPT)

# How two states of one session combine. All but the counts compare (seq, value) pairs.
_FIRST = ("root", "seen", "first_prompt", "first_activity")
_LAST = ("custom_title", "ai_title", "last_prompt", "last_activity", "last_seq")
_SUMS = ("message_count", "malformed_count")


def change_plan(stored: DataFrame, current: DataFrame, forced: bool = False) -> DataFrame:
    """What to do with each file: ``skip``, ``resume`` at an offset, ``full`` (with a reason) or ``prune``.

    ``stored`` and ``current`` are keyed by session; the order of the tests matters.
    """
    s, c = stored.alias("s"), current.alias("c")
    joined = s.join(c, F.col("s.session_id") == F.col("c.session_id"), "full_outer")
    known, seen = F.col("s.session_id").isNotNull(), F.col("c.session_id").isNotNull()
    same = (F.col("s.size") == F.col("c.size")) & F.col("s.mtime").eqNullSafe(F.col("c.mtime"))
    rewritten = F.upper("s.head_sha256") != F.upper("c.head_sha256")
    reason = (
        F.when(~seen, F.lit(None).cast("string"))
        .when(F.lit(forced), F.lit("forced"))
        .when(~known, F.lit("never_indexed"))
        .when(same, F.lit(None).cast("string"))
        .when(F.col("c.size") < F.col("s.parse_offset"), F.lit("file_truncated"))
        .when(F.coalesce(rewritten, F.lit(False)), F.lit("head_changed"))
    )
    plan = (
        F.when(~F.col("seen"), F.lit("prune"))
        .when(F.col("reason").isNotNull(), F.lit("full"))
        .when(F.col("same"), F.lit("skip"))
        .otherwise(F.lit("resume"))
    )
    extra = [F.col(f"c.{name}").alias(name) for name in current.columns if name not in ("session_id", "size", "mtime", "head_sha256")]
    return (
        joined.select(
            F.coalesce("s.session_id", "c.session_id").alias("session_id"), *extra,
            F.col("c.size").alias("size"), F.col("c.mtime").alias("mtime"), F.col("c.head_sha256").alias("head_sha256"),
            F.col("s.parse_offset").alias("stored_offset"), F.col("s.head_sha256").alias("stored_head"), F.col("s.size").alias("stored_size"),
            seen.alias("seen"), F.coalesce(same & known, F.lit(False)).alias("same"), reason.alias("reason"),
        )
        .withColumn("plan", plan)
        .withColumn("offset", F.when(F.col("plan") == "resume", F.col("stored_offset")).otherwise(F.lit(0)))
        .drop("seen", "same")
    )


def merge_states(stored: DataFrame, tail: DataFrame, key: str = "session_id") -> DataFrame:
    """State of each session after a tail was read: first values stay, last values move, counts add."""
    s, t = stored.select(key, *STATE_COLUMNS).alias("s"), tail.select(key, *STATE_COLUMNS).alias("t")
    joined = s.join(t, F.col(f"s.{key}") == F.col(f"t.{key}"), "full_outer")

    def both(name: str) -> tuple[Column, Column]:
        return F.col(f"s.{name}"), F.col(f"t.{name}")

    merged = {name: F.least(*both(name)) for name in _FIRST}
    merged |= {name: F.greatest(*both(name)) for name in _LAST}
    merged |= {name: F.coalesce(both(name)[0], F.lit(0)) + F.coalesce(both(name)[1], F.lit(0)) for name in _SUMS}
    return joined.select(F.coalesce(*both(key)).alias(key), *[merged[name].alias(name) for name in STATE_COLUMNS])


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "session_id") -> DataFrame:
    """Incoming rows replace stored rows of the same key; both have the same columns."""
    columns = [c for c in stored.columns if c != key]
    s = stored.select(key, F.struct(*columns).alias("old"))
    n = incoming.select(key, F.struct(*columns).alias("new"))
    merged = s.join(n, key, "full_outer").select(key, F.coalesce("new", "old").alias("row"))
    return merged.select(key, "row.*").select(*stored.columns)


def replace_chunks(stored: DataFrame, incoming: DataFrame, replaced: DataFrame) -> DataFrame:
    """Full replace: chunks of the sessions in ``replaced`` go, incoming chunks come."""
    return stored.join(replaced.select("session_id"), "session_id", "left_anti").unionByName(incoming)


def replace_derived(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Tail merge of chunks: derived kinds the tail produced are replaced, all else is kept."""
    produced = incoming.where(F.col("kind").isin(*DERIVED_KINDS)).select("session_id", "kind").distinct()
    return stored.join(produced, ["session_id", "kind"], "left_anti").select(stored.columns).unionByName(incoming)


def prune(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of sessions that still exist."""
    return rows.join(live.select("session_id"), "session_id", "left_semi")


def pruned_sessions(sessions: DataFrame, live: DataFrame) -> DataFrame:
    return sessions.select("session_id").join(live.select("session_id"), "session_id", "left_anti")


def outcomes(plan: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    """Adds what became of each file.

    ``tail`` says what a pass read per session: ``(session_id, readable, has_message, chunks, bytes, parse_error)``
    and, where it looked, ``missing``: files that went between listing and reading.
    """
    joined = plan.join(tail, "session_id", "left") if tail is not None else plan
    outcome = (
        F.when(F.col("plan") == "prune", F.lit("pruned"))
        .when(F.col("plan") == "skip", F.lit("skipped"))
        .when(F.coalesce("missing", F.lit(False)) if "missing" in joined.columns else F.lit(False), F.lit("missing"))
        .when(~F.coalesce("readable", F.lit(True)), F.lit("failed"))
        .when(F.col("plan") == "full", F.lit("indexed"))
        .when(F.coalesce("has_message", F.lit(False)), F.lit("appended"))
        .otherwise(F.lit("title_refreshed"))
    )
    return joined.withColumn("outcome", outcome)


def reconcile_tally(told: DataFrame) -> DataFrame:
    """One row of counters over the outcomes of a pass."""
    outcome = F.col("outcome")
    return told.agg(
        F.count_if(outcome != "pruned").alias("discovered"),
        F.count_if(outcome.isin("indexed", "appended", "title_refreshed")).alias("indexed"),
        F.count_if(outcome.isin("skipped", "missing")).alias("skipped"),
        F.count_if(outcome == "failed").alias("failed"),
        F.count_if(outcome == "pruned").alias("pruned"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks_written"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_read"),
        F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"),
    )
