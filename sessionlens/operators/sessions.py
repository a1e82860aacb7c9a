"""Records to session rows.

A session's state is built by commutative aggregates only, so it is combined map-side before the
shuffle: a session that holds a third of all records costs one small row per task, and the state of
a tail can be merged into a stored state with the same rules (see :mod:`sessionlens.operators.merge`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlens import constants as K
from sessionlens.functions import text as X

STATE_COLUMNS = (
    "root", "seen", "custom_title", "ai_title", "last_prompt", "first_prompt",
    "first_activity", "last_activity", "message_count", "malformed_count", "last_seq",
)

SESSION_COLUMNS = (
    "session_id", "file_path", "title", "title_source", "custom_title", "ai_title", "first_prompt",
    "folder_display", "folder_key", "folder_source", "git_branch", "last_prompt",
    "first_activity", "last_activity", "message_count",
    "file_size", "mtime", "head_sha256", "parse_offset", "parse_error", "indexed_at",
)


def is_prompt() -> Column:
    """A record a person wrote: not a tool result, not meta, with a message."""
    return (F.col("type") == "user") & ~F.col("has_tool_result") & ~F.col("is_meta") & F.col("has_message")


def is_reply() -> Column:
    return (F.col("type") == "assistant") & F.col("has_message")


def classify_records(records: DataFrame) -> DataFrame:
    """Adds which records count as prompts and replies."""
    return records.withColumns({"is_prompt": is_prompt(), "is_reply": is_reply()})


def session_state(records: DataFrame, keys: tuple[str, ...] = ("owner", "session_id")) -> DataFrame:
    """One mergeable state per session: bounds, counts, and the first or last value by ``seq``."""
    seq = F.col("seq")

    def last_of(kind: str) -> Column:
        text = F.left(F.col("title_text"), F.lit(K.STORED_CANDIDATE_LENGTH))
        if kind == "last-prompt":
            text = F.col("title_text")
        return F.max(F.when((F.col("type") == kind) & F.col("title_text").isNotNull(), F.struct(seq.alias("seq"), text.alias("text"))))

    place = F.struct(seq.alias("seq"), F.col("cwd").alias("cwd"), F.col("git_branch").alias("branch"))
    has_cwd = F.col("cwd").isNotNull()
    opening = has_cwd & (F.col("type") == "user") & ~F.col("has_parent")
    prompt_text = F.left(F.get("blocks", F.lit(0)), F.lit(K.STORED_CANDIDATE_LENGTH))
    prompt = F.struct(seq.alias("seq"), prompt_text.alias("text"))
    state = records.groupBy(*keys).agg(
        F.min(F.when(opening, place)).alias("root"),
        F.min(F.when(has_cwd, place)).alias("seen"),
        last_of("custom-title").alias("custom_title"),
        last_of("ai-title").alias("ai_title"),
        last_of("last-prompt").alias("last_prompt"),
        F.min(F.when(is_prompt() & (F.size("blocks") > 0), prompt)).alias("first_prompt"),
        F.min("ts").alias("first_activity"),
        F.max("ts").alias("last_activity"),
        F.count_if(is_prompt() | is_reply()).alias("message_count"),
        F.count_if(F.col("malformed")).alias("malformed_count"),
        F.max(seq).alias("last_seq"),
    )
    return state


def finish_sessions(state: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Resolve title, folder, branch and parse error from a state. Keeps the state columns."""
    title, source = X.resolve_title(
        F.col("custom_title.text"), F.col("ai_title.text"), F.col("first_prompt.text"), F.col(file_name)
    )
    display = X.folder_display(F.coalesce(F.col("root.cwd"), F.col("seen.cwd")))
    # The opening record decides; the first record with a folder stands in when there is none.
    display = F.when(F.col("root").isNotNull(), X.folder_display(F.col("root.cwd"))).otherwise(display)
    with_folder = state.withColumns(
        {
            "title": title,
            "title_source": source,
            "folder_display": display,
            "git_branch": X.empty_to_null(F.coalesce(F.col("root.branch"), F.col("seen.branch"))),
        }
    )
    return with_folder.withColumns(
        {
            "folder_key": X.folder_key(F.col("folder_display")),
            "folder_source": F.when(F.col("folder_display").isNull(), F.lit(K.FOLDER_UNKNOWN)).otherwise(F.lit(K.FOLDER_TRANSCRIPT)),
            "parse_error": F.when(
                F.col("malformed_count") > 0,
                F.format_string("%d line(s) skipped: not well-formed JSON.", F.col("malformed_count")),
            ),
        }
    )


def build_sessions(records: DataFrame) -> DataFrame:
    """Session rows of a set of records (no file fingerprint columns)."""
    state = session_state(records, ("owner", "session_id", "file_path", "file_name"))
    done = finish_sessions(state)
    return done.select(
        "owner", "session_id", "file_path", "title", "title_source",
        F.col("custom_title.text").alias("custom_title"),
        F.col("ai_title.text").alias("ai_title"),
        F.col("first_prompt.text").alias("first_prompt"),
        "folder_display", "folder_key", "folder_source", "git_branch",
        X.empty_to_null(F.col("last_prompt.text")).alias("last_prompt"),
        "first_activity", "last_activity", "message_count", "malformed_count", "parse_error",
    )


def recent_sessions(sessions: DataFrame, limit: int = K.RESULT_LIMIT) -> DataFrame:
    """The newest sessions, those without a time last. A bounded heap per task, no global sort."""
    return sessions.orderBy(F.col("last_activity").desc_nulls_last(), F.col("session_id")).limit(limit)
