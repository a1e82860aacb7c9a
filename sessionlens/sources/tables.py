"""Adapters: the shared test tables in the shape of our own tables.

Every adapter is a projection of the whole table, so work grows with it. The same rules are
written in SQL in :mod:`sessionlens.plans.oracles`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionlens import constants as K
from sessionlens.functions import text as X

EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z
MONTH_MINUTES = 43_200
CONVERSATIONS_PER_OWNER = 40
CUSTOMERS_PER_OWNER = 500
ZONE = "America/Sao_Paulo"  # UTC-3, no daylight saving in 2024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are costly to process. A small one is stored in fewer splits than there are
    cores and is spread over them; a large one is read as it is split, without a shuffle."""
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def _month_instant(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + minutes * 60)


def conversation_records(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Conversations as transcript records: one conversation is one session, one turn one record.

    ``rows`` may be a stream of the same table.
    """
    c = rows if rows is not None else text_table(spark, sf_dir, "conversations")
    conv, turn, role, text = F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")
    kind = (
        F.when((role == "system") & (conv % 2 == 0), F.lit("ai-title"))
        .when((role == "assistant") & (turn == 5), F.lit("custom-title"))
        .when((role == "user") & (turn == 6), F.lit("last-prompt"))
        .otherwise(role)
    )
    project = F.concat(F.lit("/work/p"), (conv % 7).cast("string"))
    folder = F.when(conv % 2 == 1, F.concat(F.upper(project), F.lit("/"))).otherwise(project)
    folder = F.when(turn >= 4, F.concat(project, F.lit("/src"))).otherwise(folder)
    branch = (
        F.when(conv % 4 == 1, F.lit("HEAD"))
        .when(conv % 4 == 2, F.lit("main"))
        .when(conv % 4 == 3, F.concat(F.lit("fix/"), (conv % 5).cast("string")))
    )
    spoken = (
        F.when((role == "user") & (turn % 5 == 4), F.lit("[Request interrupted by user]"))
        .when((role == "user") & (turn % 3 == 0), F.concat(F.lit("<ide_selection>line "), turn.cast("string"), F.lit("</ide_selection>"), text))
        .otherwise(text)
    )
    is_message = kind.isin("user", "assistant")
    is_title = kind.isin("custom-title", "ai-title", "last-prompt")
    ignored = kind.isin(*K.IGNORED_TYPES)
    return c.select(
        F.floor(conv / CONVERSATIONS_PER_OWNER).cast("string").alias("owner"),
        conv.cast("string").alias("session_id"),
        F.concat(F.lit("/logs/"), conv.cast("string"), F.lit(".jsonl")).alias("file_path"),
        F.concat(F.lit("conversation "), conv.cast("string")).alias("file_name"),
        (turn + 1).alias("seq"),
        kind.alias("type"),
        (turn > 1).alias("has_parent"),
        F.lit(False).alias("is_meta"),
        F.lit(False).alias("has_tool_result"),
        F.when(~ignored & ~is_title, folder).alias("cwd"),
        F.when(~ignored & ~is_title, branch).alias("git_branch"),
        _month_instant((conv * 197) % MONTH_MINUTES + turn * 3).alias("ts"),
        F.when(is_title, text).alias("title_text"),
        is_message.alias("has_message"),
        F.when(is_message & ~X.is_blank(spoken), F.array(spoken)).otherwise(F.array().cast("array<string>")).alias("blocks"),
        F.lit(False).alias("malformed"),
    )


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text blocks: four neighbouring documents form one session, kinds alternate."""
    d = text_table(spark, sf_dir, "documents")
    return d.select(
        F.floor(F.col("doc_id") / 4).cast("string").alias("session_id"),
        (F.col("doc_id") % 4 + 1).alias("seq"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("kind"),
        _month_instant((F.col("doc_id") * 37) % MONTH_MINUTES).alias("ts"),
        F.array("text").alias("blocks"),
    )


def document_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session rows for the document corpus: folder from ``source``, activity from its documents."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.floor(F.col("doc_id") / 4).cast("string").alias("session_id")).agg(
        F.min("source").alias("title"),
        F.max(_month_instant((F.col("doc_id") * 37) % MONTH_MINUTES)).alias("last_activity"),
        F.count("*").alias("message_count"),
        F.concat(F.lit("/corpus/"), F.min("lang")).alias("folder_display"),
        F.max("lang").alias("git_branch"),
        F.concat(F.lit("/corpus/"), F.min("doc_id").cast("string"), F.lit(".jsonl")).alias("file_path"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts: each benchmark item as a whole; in every other one a hyphen joins the first two words."""
    joined = F.regexp_replace(F.col("text"), r"^(\S+)\s+", "$1-")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 1, joined).otherwise(F.col("text")).alias("text"))


def event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as message chunks: the user owns four sessions, three event types are prompts."""
    e = table(spark, sf_dir, "events")
    slot = F.try_variant_get(F.try_parse_json("props"), "$.k", "long") % 4
    typed = F.col("event_type")
    said = F.concat_ws(" ", typed, F.lit("worth"), F.format_string("%.2f", F.col("value")), F.lit("props"), F.col("props"))
    text = (
        F.when(typed == "signup", F.concat(F.lit("<notice>"), F.col("props"), F.lit("</notice>")))
        .when(typed == "view", F.concat(F.lit("<page_view>"), F.col("props"), F.lit("</page_view> look at\n"), said))
        .otherwise(said)
    )
    return e.select(
        F.col("user_id").cast("string").alias("owner"),
        F.concat_ws("-", F.col("user_id").cast("string"), slot.cast("string")).alias("session_id"),
        F.col("event_id").alias("chunk_no"),
        F.when(typed == "error", F.lit(K.KIND_ASSISTANT_TEXT)).otherwise(F.lit(K.KIND_USER_PROMPT)).alias("kind"),
        F.date_trunc("second", "ts").alias("ts"),
        text.alias("text"),
    )


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session of :func:`event_chunks`."""
    c = event_chunks(spark, sf_dir).select("owner", "session_id", "ts")
    slot = F.element_at(F.split("session_id", "-"), -1).cast("int")
    display = F.concat(F.lit("/home/u"), F.col("owner"), F.lit("/app"), (slot % 2).cast("string"), F.when(slot >= 2, F.lit("/web")).otherwise(F.lit("")))
    return (
        c.groupBy("owner", "session_id")
        .agg(F.min("ts").alias("first_activity"), F.max("ts").alias("last_activity"))
        .select(
            "owner", "session_id",
            F.concat(F.lit("Session "), F.col("session_id")).alias("title"),
            display.alias("folder_display"),
            X.folder_key(display).alias("folder_key"),
            F.when(slot == 1, F.lit("HEAD")).when(slot == 2, F.lit("main")).when(slot == 3, F.lit("fix/web")).alias("git_branch"),
            "first_activity", "last_activity",
        )
    )


def event_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository per user at ``/home/u<id>/app0``; ``app1`` has none."""
    return (
        table(spark, sf_dir, "events").select("user_id").distinct()
        .select(
            F.col("user_id").cast("string").alias("owner"),
            F.concat(F.lit("/home/u"), F.col("user_id").cast("string"), F.lit("/app0")).alias("root"),
            F.concat(F.lit("dev"), F.col("user_id").cast("string")).alias("author"),
        )
    )


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of the customer with the same number, spread over the month."""
    o = table(spark, sf_dir, "orders")
    user = F.col("o_custkey").cast("string")
    return o.select(
        user.alias("owner"),
        F.concat(F.lit("/home/u"), user, F.lit("/app0")).alias("repo_root"),
        F.when(F.col("o_orderstatus") == "P", F.lit("somebody else")).otherwise(F.concat(F.lit("Dev <dev"), user, F.lit("@example.org>"))).alias("author"),
        F.left(F.md5(F.col("o_orderkey").cast("string")), F.lit(7)).alias("sha"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("subject"),
        _month_instant((F.col("o_orderkey") * 7) % MONTH_MINUTES).alias("ts"),
    )


def conversation_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories seen in conversations: every project folder but one is the root of one."""
    c = table(spark, sf_dir, "conversations")
    project = (F.col("conv_id") % 7).cast("string")
    return (
        c.select(F.floor(F.col("conv_id") / CONVERSATIONS_PER_OWNER).cast("string").alias("owner"), project.alias("p"))
        .distinct()
        .where(F.col("p") != "6")
        .select("owner", F.concat(F.lit("/work/p"), F.col("p")).alias("root"), F.concat(F.lit("owner"), F.col("owner")).alias("author"))
    )


def conversation_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits in the conversation projects."""
    o = table(spark, sf_dir, "orders")
    owner = F.floor(F.col("o_custkey") / CUSTOMERS_PER_OWNER).cast("string")
    return o.select(
        owner.alias("owner"),
        F.concat(F.lit("/work/p"), (F.col("o_orderkey") % 7).cast("string")).alias("repo_root"),
        F.when(F.col("o_orderstatus") == "P", F.lit("somebody else")).otherwise(F.concat(F.lit("Owner <owner"), owner, F.lit("@example.org>"))).alias("author"),
        F.left(F.md5(F.col("o_orderkey").cast("string")), F.lit(7)).alias("sha"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("subject"),
        _month_instant((F.col("o_orderkey") * 7) % MONTH_MINUTES).alias("ts"),
    )


def order_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two file snapshots from orders: what was indexed before 2000, and what is on disk now.

    The priority decides what happened to the file in between; low-priority files are gone.
    """
    o = table(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    size = F.floor(F.col("o_totalprice")).cast("bigint")
    head = F.upper(F.sha2(F.col("o_orderkey").cast("string"), 256))
    stored = o.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")).select(
        F.col("o_orderkey").cast("string").alias("session_id"),
        size.alias("size"),
        F.col("o_orderdate").alias("mtime"),
        F.when(F.col("o_orderstatus") != "P", head).alias("head_sha256"),
        F.floor(size * 3 / 4).cast("bigint").alias("parse_offset"),
    )
    current = o.where(priority != "5-LOW").select(
        F.col("o_orderkey").cast("string").alias("session_id"),
        F.when(priority == "1-URGENT", size + 1000).when(priority == "2-HIGH", F.floor(size / 2).cast("bigint")).otherwise(size).alias("size"),
        F.when(priority == "4-NOT SPECIFIED", F.col("o_orderdate")).otherwise(F.lit("2001-12-31").cast("timestamp")).alias("mtime"),
        F.when(priority == "3-MEDIUM", F.upper(F.sha2(F.lit("rewritten"), 256))).otherwise(F.lower(head)).alias("head_sha256"),
    )
    return stored, current
