"""Text chunks: what search and recap read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlens import constants as K
from sessionlens.functions import text as X
from sessionlens.operators.sessions import is_prompt, is_reply

_SPACE = r"[ \t\n\r\f\x0B\x{A0}]"
# One alternative per way a piece can end: the rest of the text when it fits, else the last space in
# the second half of the window, else the window itself.
_PIECE = (
    rf"(?s).{{1,{K.CHUNK_LENGTH}}}\z"
    rf"|.{{{K.CHUNK_LENGTH // 2},{K.CHUNK_LENGTH - 1}}}(?={_SPACE})"
    rf"|.{{{K.CHUNK_LENGTH}}}"
)


def split_text(text: Column) -> Column:
    """Pieces of at most 8192 characters; short texts pass through untouched."""
    return F.when(F.length(text) <= K.CHUNK_LENGTH, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    )


def _numbered(pieces: Column) -> Column:
    """Blank pieces dropped; the rest numbered in order."""
    kept = F.filter(pieces, lambda p: ~X.is_blank(p))
    return F.transform(kept, lambda p, i: F.struct(i.alias("n"), p.alias("text")))


def chunk_number(seq: Column, position: Column) -> Column:
    return F.shiftleft(seq.cast("bigint"), K.CHUNK_NO_SHIFT) + position


def split_blocks(blocks: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """``(keys, seq, kind, ts, blocks)`` to chunk rows. A projection: text is never shuffled."""
    pieces = F.flatten(F.transform("blocks", split_text))
    return blocks.select(*keys, "seq", "kind", "ts", F.inline(_numbered(pieces))).select(
        *keys, chunk_number(F.col("seq"), F.col("n")).alias("chunk_no"), "kind", "ts", "text"
    )


def message_chunks(records: DataFrame, keys: tuple[str, ...] = ("owner", "session_id")) -> DataFrame:
    """Chunks of prompts and replies."""
    kind = F.when(is_prompt(), F.lit(K.KIND_USER_PROMPT)).when(is_reply(), F.lit(K.KIND_ASSISTANT_TEXT))
    spoken = records.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.size("blocks") > 0))
    return split_blocks(spoken, keys)


def derived_chunks(sessions: DataFrame, keys: tuple[str, ...] = ("owner", "session_id")) -> DataFrame:
    """Title, folder and last-prompt chunks of each session, stamped with its last activity."""
    folder = X.folder_text(F.col("folder_display"), F.col("git_branch"))
    title = F.array(F.struct(F.lit(K.KIND_TITLE).alias("kind"), X.cap(F.col("title"), K.CHUNK_LENGTH).alias("text")))
    place = F.when(
        F.col("folder_display").isNotNull(),
        F.array(F.struct(F.lit(K.KIND_FOLDER).alias("kind"), X.cap(folder, K.CHUNK_LENGTH).alias("text"))),
    ).otherwise(F.array().cast("array<struct<kind:int,text:string>>"))
    prompt = F.transform(
        F.filter(F.coalesce(split_text(F.col("last_prompt")), F.array().cast("array<string>")), lambda p: ~X.is_blank(p)),
        lambda p: F.struct(F.lit(K.KIND_LAST_PROMPT).alias("kind"), p.alias("text")),
    )
    return (
        sessions.select(*keys, F.col("last_activity").alias("ts"), F.posexplode(F.concat(title, place, prompt)).alias("n", "c"))
        .select(*keys, chunk_number(F.lit(0), F.col("n")).alias("chunk_no"), F.col("c.kind").alias("kind"), "ts", F.col("c.text").alias("text"))
    )


def all_chunks(records: DataFrame, sessions: DataFrame, keys: tuple[str, ...] = ("owner", "session_id")) -> DataFrame:
    return derived_chunks(sessions, keys).unionByName(message_chunks(records, keys))


def activity(chunks: DataFrame, sessions: DataFrame, start: Column, end: Column, with_replies: bool = True) -> DataFrame:
    """Message chunks in ``[start, end)`` of sessions active then; nothing when the window is empty.

    Both range filters sit below the join and reach the scans.
    """
    kinds = [K.KIND_USER_PROMPT] + ([K.KIND_ASSISTANT_TEXT] if with_replies else [])
    valid = start < end
    near = sessions.where(
        valid & (F.col("last_activity") >= start) & (F.col("first_activity").isNull() | (F.col("first_activity") < end))
    ).select("session_id", "title", "folder_display", "git_branch")
    said = chunks.where(valid & F.col("kind").isin(kinds) & (F.col("ts") >= start) & (F.col("ts") < end))
    return said.join(near, "session_id")


def in_reading_order(activity_rows: DataFrame) -> DataFrame:
    """Globally ordered by session, time, chunk. Range partitioning splits a very long session."""
    order = ["session_id", "ts", "chunk_no"]
    return activity_rows.repartitionByRange(*order).sortWithinPartitions(*order)
