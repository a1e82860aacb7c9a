"""Every operator as a query over the shared test tables. Each reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sessionlens import constants as K
from sessionlens.functions import scoring, text as X, time as T
from sessionlens.operators import chunks as C, index as I, merge as M, recap as R, recap_text as RT, search as S, sessions as SE, stats
from sessionlens.plans.reconcile import SessionIndex
from sessionlens.session import checkpoint_dir, stage
from sessionlens.sources import commits as G, tables as A, transcripts
from sessionlens.streaming import changes, follow

NOW = "2024-01-31 12:00:00"
CALENDAR = R.Calendar(A.ZONE)
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def joined(column: str, kind: str = "string") -> Column:
    """An array as text, so that results compare by value."""
    return F.array_join(F.col(column).cast(f"array<{kind}>").cast("array<string>"), ",").alias(column)


# ---------------------------------------------------------------- sessions and chunks


@query
def recent_sessions(spark, sf):
    sessions = SE.build_sessions(A.conversation_records(spark, sf))
    return SE.recent_sessions(sessions).select("session_id", "title", "folder_display", "git_branch", "last_activity", "message_count")


@query
def sessions(spark, sf):
    built = SE.build_sessions(A.conversation_records(spark, sf))
    return built.select("owner", "session_id", "title", "title_source", "folder_display", "folder_key", "folder_source",
                        "git_branch", "last_prompt", "first_activity", "last_activity", "message_count", "parse_error")


@query
def titles(spark, sf):
    built = SE.build_sessions(A.conversation_records(spark, sf))
    return built.select("session_id", "custom_title", "ai_title", "first_prompt", "title", "title_source")


@query
def record_filter(spark, sf):
    records = SE.classify_records(A.conversation_records(spark, sf))
    return records.groupBy("type").agg(
        F.count("*").alias("records"), F.count_if("is_prompt").alias("prompts"), F.count_if("is_reply").alias("replies"),
        F.count("cwd").alias("with_folder"), F.count("title_text").alias("with_title"))


@query
def record_types(spark, sf):
    """Types of conversation turns as JSON; a name nobody knows and a number count as ``unknown``."""
    name = F.when(F.col("turn") == 7, F.lit("brand-new")).otherwise(F.col("role"))
    kind = F.when(F.col("turn") == 3, F.col("turn").cast("variant")).otherwise(name.cast("variant"))
    doc = F.try_parse_json(F.to_json(F.struct(kind.alias("type"))))
    return A.table(spark, sf, "conversations").select(transcripts.record_type(doc).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query
def records_json(spark, sf):
    """Conversations written as JSON lines, content as string or block array, and read back."""
    said = F.get("blocks", F.lit(0))
    content = F.when(F.col("seq") % 2 == 0, F.to_variant_object(F.array(F.struct(F.lit("text").alias("type"), said.alias("text"))))).otherwise(said.cast("variant"))

    def title(kind: str) -> Column:
        return F.when(F.col("type") == kind, F.col("title_text"))

    line = F.to_json(F.struct(
        "type", "cwd", F.col("git_branch").alias("gitBranch"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.when(F.col("has_parent"), F.lit("p")).alias("parentUuid"),
        title("custom-title").alias("customTitle"), title("ai-title").alias("aiTitle"), title("last-prompt").alias("lastPrompt"),
        F.when(F.col("has_message"), F.struct(F.lit("x").alias("role"), content.alias("content"))).alias("message"),
    ))
    lines = A.conversation_records(spark, sf).select("session_id", "seq", line.alias("line"))
    return transcripts.parse_lines(lines).select(
        "session_id", "seq", "type", "has_parent", "cwd", "git_branch", "ts", "title_text", "has_message",
        F.get("blocks", F.lit(0)).alias("text"), "malformed")


@query
def props_json(spark, sf):
    e = A.table(spark, sf, "events")
    doc = F.try_parse_json("props")
    return e.select("event_id", F.try_variant_get(doc, "$.k", "bigint").alias("k"), doc.isNull().alias("malformed"))


@query
def malformed_count(spark, sf):
    """Pages as would-be JSON lines: none is an object, so every one is counted as malformed."""
    pages = A.table(spark, sf, "pages").select(F.col("page_id").alias("seq"), F.col("html").alias("line"))
    parsed = transcripts.parse_lines(pages)
    return parsed.groupBy("type").agg(
        F.count("*").alias("lines"),
        F.count_if("malformed").alias("malformed"),
        F.format_string("%d line(s) skipped: not well-formed JSON.", F.count_if("malformed")).alias("parse_error"))


@query
def session_ids(spark, sf):
    """Paths named after a hash in UUID form; every page with a query string gets a bad name."""
    h = F.md5(F.col("page_id").cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    path = F.when(F.contains("url", F.lit("?")), F.concat(F.lit("/logs/x"), uuid, F.lit(".jsonl"))).otherwise(F.concat(F.lit("C:\\logs\\"), F.upper(uuid), F.lit(".jsonl")))
    return A.table(spark, sf, "pages").select("page_id", path.alias("path"), transcripts.session_id_of(path).alias("session_id"))


@query
def file_heads(spark, sf):
    """Every page as a file that tasks write: listed with its size, and the fingerprint of its first bytes."""
    folder = f"{checkpoint_dir(spark)}/heads-{uuid.uuid4().hex}"
    pages = A.table(spark, sf, "pages").select(
        _session_file(F.col("page_id")).alias("session_id"), F.concat(F.lit("folder "), (F.col("page_id") % 8).cast("string")).alias("folder"), F.lit(1).alias("seq"), F.coalesce("html", F.lit("")).alias("line"))
    transcripts.write_transcripts(pages, folder)
    files = stage(transcripts.list_files(spark, folder), "files")
    heads = transcripts.head_hashes(files).select("file_path", "head_sha256", "readable")
    page = F.conv(F.substring("session_id", 1, 8), 16, 10).cast("bigint")
    return files.join(heads, "file_path").select(page.alias("page_id"), F.col("size").cast("bigint").alias("size"), F.upper("head_sha256").alias("head_sha256"), "readable")


@query
def chunks_split(spark, sf):
    chunks = C.split_blocks(A.document_blocks(spark, sf))
    return chunks.select("session_id", "chunk_no", "kind", "ts", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def _conversation_tables(spark, sf):
    records = A.conversation_records(spark, sf)
    built = SE.build_sessions(records)
    return built, C.all_chunks(records, built)


@query
def chunks_derived(spark, sf):
    built = SE.build_sessions(A.conversation_records(spark, sf))
    return C.derived_chunks(built).select("session_id", "chunk_no", "kind", "ts", "text")


@query
def chunks_all(spark, sf):
    _, chunks = _conversation_tables(spark, sf)
    return chunks.select("session_id", "chunk_no", "kind", "ts", F.md5("text").alias("digest"))


@query
def chunk_kinds(spark, sf):
    _, chunks = _conversation_tables(spark, sf)
    one = stats.chunks_by_kind(chunks)
    text = F.array_join(F.transform(F.map_entries("by_kind"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return one.select(text.alias("by_kind"), "chunks")


@query
def kinds_pivot(spark, sf):
    return stats.kinds_pivot(_conversation_tables(spark, sf)[1])


@query
def index_stats(spark, sf):
    built, chunks = _conversation_tables(spark, sf)
    done = A.table(spark, sf, "events").select(F.date_trunc("second", "ts").alias("completed_at"))
    row = stats.index_statistics(built, chunks, done)
    text = F.array_join(F.transform(F.map_entries("by_kind"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return row.withColumn("by_kind", text)


@query
def activity_window(spark, sf):
    built, chunks = _conversation_tables(spark, sf)
    rows = C.activity(chunks, built, F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-09").cast("timestamp"))
    return C.in_reading_order(rows).select("session_id", "ts", "chunk_no", "kind", "title", "git_branch", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- scalar functions


@query
def collapse_text(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.collapse(F.col("text"))).alias("line"), X.truncate(X.collapse(F.col("text"))).alias("title"))


@query
def truncate_words(spark, sf):
    d = A.table(spark, sf, "documents")
    line = X.collapse(F.col("text"))
    return d.select("doc_id", X.truncate_words(line, K.KEY_PROMPT_LENGTH).alias("short"), X.truncate_words(line, K.OUTCOME_LENGTH).alias("long"),
                    F.length(X.cap(F.col("text"), K.STORED_CANDIDATE_LENGTH)).alias("stored"))


@query
def prompt_clean(spark, sf):
    r = A.conversation_records(spark, sf).where(F.col("type") == "user")
    raw = F.get("blocks", F.lit(0))
    return r.select("session_id", "seq", X.clean_prompt(raw).alias("prompt"), X.clean_prompt(raw).isNotNull().alias("is_human"))


@query
def folders(spark, sf):
    """Page addresses as folders, with trailing separators, drive letters and roots mixed in."""
    p = A.table(spark, sf, "pages")
    raw = F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "")
    path = F.when(F.col("page_id") % 5 == 0, F.concat(raw, F.lit("//"))).when(F.col("page_id") % 7 == 0, F.lit("///")).when(F.col("page_id") % 11 == 0, F.lit(" c:\\ ")).otherwise(raw)
    display = X.folder_display(path)
    return p.select("page_id", display.alias("display"), X.folder_key(display).alias("key"), X.base_name(display).alias("name"),
                    X.folder_text(display, F.when(F.col("page_id") % 3 == 0, F.lit("main")).when(F.col("page_id") % 3 == 1, F.lit("  "))).alias("searched"))


@query
def branches(spark, sf):
    r = A.conversation_records(spark, sf)
    return r.groupBy(X.real_branch(F.col("git_branch")).alias("branch")).agg(F.count("*").alias("n"), F.count(X.empty_to_null(F.col("git_branch"))).alias("named"))


@query
def working_day(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("event_id", T.working_day(F.col("ts"), A.ZONE).alias("day"), F.date_format(T.to_local(F.col("ts"), A.ZONE), "HH:mm").alias("clock"))


@query
def day_start(spark, sf):
    day = T.working_day(F.col("ts"), A.ZONE)
    return A.table(spark, sf, "events").select(day.alias("day")).distinct().select("day", T.day_start_instant(F.col("day"), A.ZONE).alias("starts_at"))


@query
def relative_age(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").alias("ts"))
    return e.select("event_id", T.relative_age(F.col("ts"), F.lit("2024-01-24 12:00:00").cast("timestamp"), A.ZONE).alias("age"))


@query
def day_labels(spark, sf):
    day, today = F.to_date("o_orderdate"), F.lit("2000-06-15").cast("date")
    return A.table(spark, sf, "orders").select(day.alias("day")).distinct().select(
        "day", T.day_label(F.col("day"), today).alias("label"), T.age_heading(F.col("day"), today).alias("heading"),
        T.week_label(F.col("day"), F.greatest(F.col("day"), today)).alias("week"))


@query
def spans(spark, sf):
    e = A.table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return e.select("user_id", "day", T.span(T.to_local(F.col("first"), A.ZONE), T.to_local(F.col("last"), A.ZONE)).alias("span"), X.count_noun(F.col("n"), "event").alias("counted"))


@query
def epoch_millis(spark, sf):
    e = A.table(spark, sf, "events")
    ms = T.to_epoch_millis(F.col("ts").cast("timestamp"))
    return e.select("event_id", ms.alias("ms"), T.from_epoch_millis(ms).alias("back"),
                    T.parse_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("parsed"), T.parse_iso(F.col("props")).alias("not_a_time"))


@query
def recency(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").alias("ts"), "value")
    kind = (F.col("event_id") % 7).cast("int")
    return e.select("event_id", F.round(scoring.recency_multiplier(F.col("ts"), F.lit("2024-01-20").cast("timestamp")), 9).alias("recency"), scoring.kind_weight(kind).alias("weight"))


@query
def tokens(spark, sf):
    """Folded tokens of three corpora, counted."""
    texts = (
        A.text_table(spark, sf, "conversations").select(F.lit("conversations").alias("corpus"), "text")
        .unionByName(A.text_table(spark, sf, "documents").select(F.lit("documents").alias("corpus"), "text"))
        .unionByName(A.text_table(spark, sf, "pages").select(F.lit("pages").alias("corpus"), F.col("html").alias("text"))))
    return texts.select("corpus", F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("corpus", "token").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- full-text search


def document_chunks(spark, sf):
    return C.split_blocks(A.document_blocks(spark, sf))


def document_index(spark, sf) -> I.Index:
    return I.build_index(document_chunks(spark, sf))


@query
def postings(spark, sf):
    p = I.build_postings(I.forward_index(document_chunks(spark, sf)))
    return p.select("token", "session_id", "chunk_no", "kind", "n_tokens", "tf", F.md5(F.array_join(F.col("positions").cast("array<string>"), ",")).alias("positions"))


@query
def prefix_vocab(spark, sf):
    vocabulary = I.forward_vocabulary(I.forward_index(document_chunks(spark, sf)))
    return I.prefix_keys(vocabulary).groupBy("prefix").agg(F.count("*").alias("tokens"), F.sum("df").alias("chunks"))


@query
def query_terms(spark, sf):
    return I.query_terms(A.benchmark_queries(spark, sf)).select("query_id", "term_no", "term", "n_terms")


@query
def phrase_hits(spark, sf):
    terms = I.distinct_terms(I.query_terms(A.benchmark_queries(spark, sf)))
    return I.phrase_hits(terms, document_index(spark, sf)).select("term", "session_id", "chunk_no", "tf")


@query
def term_hits(spark, sf):
    terms = I.distinct_terms(I.query_terms(A.benchmark_queries(spark, sf)))
    return I.term_hits(terms, document_index(spark, sf)).select("term", "session_id", "chunk_no", "kind", "n_tokens", "tf")


@query
def bm25(spark, sf):
    index = document_index(spark, sf)
    terms = I.distinct_terms(I.query_terms(A.benchmark_queries(spark, sf)))
    scored = S.relevance(stage(I.term_hits(terms, index), "hits"), index)
    return scored.select("term", "session_id", "chunk_no", F.round("relevance", 6).alias("relevance"))


@query
def qualified(spark, sf):
    terms = I.query_terms(A.benchmark_queries(spark, sf))
    return S.qualified_sessions(terms, stage(I.term_hits(I.distinct_terms(terms), document_index(spark, sf)), "hits"))


@query
def chunk_scores(spark, sf):
    scored = S.scored_chunks(A.benchmark_queries(spark, sf), document_index(spark, sf))
    return scored.select("query_id", "session_id", "chunk_no", "kind", "terms", "best_term", F.round("weighted", 6).alias("weighted"))


@query
def session_scores(spark, sf):
    scored = S.scored_chunks(A.benchmark_queries(spark, sf), document_index(spark, sf))
    s = S.session_scores(scored)
    return s.select("query_id", "session_id", F.round("lexical_score", 6).alias("lexical_score"), "match_count", joined("matched_kinds"), "chunk_no", "term")


@query
def search_batch(spark, sf):
    index = document_index(spark, sf)
    found = S.search(A.benchmark_queries(spark, sf), index, A.document_sessions(spark, sf), document_chunks(spark, sf), now())
    return found.select("query_id", "rank", "session_id", "title", "last_activity", *S.HIT_COLUMNS, "match_count", joined("matched_kinds"), "is_recent",
                        *[F.round(c, 6).alias(c) for c in ("lexical_score", "recency", "score")])


@query
def snippets(spark, sf):
    index = document_index(spark, sf)
    found = S.search(A.benchmark_queries(spark, sf), index, A.document_sessions(spark, sf), document_chunks(spark, sf), now())
    return found.select("query_id", "session_id", "snippet")


def short_queries(spark, sf):
    """One-letter, punctuation-only and blank texts from the benchmark items."""
    b = A.table(spark, sf, "benchmark")
    text = F.when(F.col("item_id") % 3 == 0, F.left("text", F.lit(1))).when(F.col("item_id") % 3 == 1, F.lit("?! --")).otherwise(F.lit("  "))
    return b.select(F.col("item_id").alias("query_id"), text.alias("text"))


@query
def search_recent_mode(spark, sf):
    found = S.recent_mode(short_queries(spark, sf), A.document_sessions(spark, sf), now())
    return found.select("query_id", "session_id", "rank", "lexical_score", F.round("recency", 6).alias("recency"), F.round("score", 6).alias("score"), "is_recent", "match_count", *S.HIT_COLUMNS)


def relevant_sessions(spark, sf):
    """Right answers: sessions with a document that holds all of a benchmark item's text as a phrase."""
    items = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(X.tokens(F.col("text")), " ").alias("term"))
    phrases = items.select("term").distinct().withColumn("tokens", F.split("term", " "))
    return phrases, items


@query
def mean_rank(spark, sf):
    index = document_index(spark, sf)
    phrases, items = relevant_sessions(spark, sf)
    labels = I.phrase_hits(phrases, index).join(items, "term").select("query_id", "session_id").distinct()
    settings = spark.range(1).select(F.lit("default").alias("setting"), F.lit(K.CO_OCCURRENCE_WEIGHT).alias("co_occurrence"), F.lit(K.REPEAT_WEIGHT).alias("repeat"))
    swept = S.weight_sweep(A.benchmark_queries(spark, sf), labels, index, A.document_sessions(spark, sf), now(), settings)
    return swept.select("setting", "queries", F.round("mean_rank", 6).alias("mean_rank"), F.round("mean_reciprocal_rank", 6).alias("mean_reciprocal_rank"))


@query
def weight_sweep(spark, sf):
    index = document_index(spark, sf)
    phrases, items = relevant_sessions(spark, sf)
    labels = I.phrase_hits(phrases, index).join(items, "term").select("query_id", "session_id").distinct()
    # Each setting is a parameter, not data.
    settings = spark.range(4).select(
        F.concat_ws("/", (F.col("id") % 2).cast("string"), F.floor(F.col("id") / 2).cast("string")).alias("setting"),
        (F.col("id") % 2 * 2.0).alias("co_occurrence"), F.floor(F.col("id") / 2).cast("double").alias("repeat"))
    swept = S.weight_sweep(A.benchmark_queries(spark, sf), labels, index, A.document_sessions(spark, sf), now(), settings)
    return swept.select("setting", "queries", F.round("mean_rank", 6).alias("mean_rank"), F.round("mean_reciprocal_rank", 6).alias("mean_reciprocal_rank"))


# ---------------------------------------------------------------- recap over conversations


def conversation_day(spark, sf):
    """Sessions, cleaned messages, recaps, projects and commits of the conversations."""
    records = A.conversation_records(spark, sf)
    built = SE.build_sessions(records)
    cleaned = R.clean_messages(R.merge_messages(C.message_chunks(records), CALENDAR))
    placed = R.session_projects(built, A.conversation_repos(spark, sf))
    recaps = R.session_recaps(cleaned, placed)
    commits = R.commits_by_day(G.own_commits(A.conversation_commits(spark, sf), A.conversation_repos(spark, sf)), CALENDAR)
    return built, cleaned, recaps, commits


def conversation_recap(spark, sf):
    """The same, with the small per-day tables staged: every text reads them many times."""
    _, cleaned, recaps, commits = conversation_day(spark, sf)
    recaps, commits = stage(recaps, "recaps"), stage(commits, "commits")
    projects = stage(R.project_recaps(recaps, commits), "projects")
    # A day is active when a session has a recap for it.
    days = recaps.select("owner", "day").distinct()
    frames = stage(R.recap_frames(days, R.every_active_day(days)), "frames")
    return frames, recaps, projects, commits


@query
def messages_merged(spark, sf):
    m = R.clean_messages(R.merge_messages(A.event_chunks(spark, sf), CALENDAR))
    return m.select("owner", "day", "session_id", "ts", "chunk_no", "kind", "text", "prompt")


@query
def active_days(spark, sf):
    return R.active_days(R.clean_messages(R.merge_messages(A.event_chunks(spark, sf), CALENDAR)))


@query
def adjacent_days(spark, sf):
    return R.adjacent_days(R.active_days(R.clean_messages(R.merge_messages(A.event_chunks(spark, sf), CALENDAR))))


@query
def lookback_days(spark, sf):
    days = R.active_days(R.clean_messages(R.merge_messages(A.event_chunks(spark, sf), CALENDAR)))
    return R.recap_frames(days, R.every_active_day(days)).select("owner", "focus", "day", F.col("age").cast("int").alias("age"))


def _asked_days(spark, sf):
    """For each user: even ids ask for a day (active or not), odd ids for the latest before today."""
    users = A.table(spark, sf, "events").select("user_id").distinct()
    return users.select(
        F.col("user_id").cast("string").alias("owner"), F.lit("2024-01-31").cast("date").alias("today"),
        F.when(F.col("user_id") % 2 == 0, F.date_add(F.lit("2024-01-10").cast("date"), (F.col("user_id") % 15).cast("int"))).alias("requested"))


@query
def focus_day(spark, sf):
    days = R.active_days(R.clean_messages(R.merge_messages(A.event_chunks(spark, sf), CALENDAR)))
    return R.focus_days(days, _asked_days(spark, sf))


@query
def focus_recap(spark, sf):
    """What each user asked for: the focus day with replies, the days before it by their prompts."""
    _, frames, told = R.focused(A.event_chunks(spark, sf), _asked_days(spark, sf), CALENDAR)
    return frames.join(R.session_days(told), ["owner", "day"]).select(
        "owner", "focus", "day", F.col("age").cast("int").alias("age"), "session_id", "prompt_count", "first_activity", "last_activity", "first_prompt_at", "last_prompt_at", "outcome", "is_quick")


@query
def key_prompts(spark, sf):
    cleaned = R.clean_messages(R.merge_messages(A.event_chunks(spark, sf), CALENDAR))
    return R.key_prompts(R.told_messages(cleaned)).select("owner", "day", "session_id", F.array_join("key_prompts", " | ").alias("key_prompts"))


@query
def session_recap(spark, sf):
    cleaned = R.clean_messages(R.merge_messages(A.event_chunks(spark, sf), CALENDAR))
    return R.session_days(R.told_messages(cleaned))


@query
def outcome(spark, sf):
    _, _, recaps, _ = conversation_day(spark, sf)
    return recaps.select("owner", "day", "session_id", "prompt_count", "is_quick", "outcome", F.array_join("key_prompts", " | ").alias("key_prompts"),
                         X.describe_session(F.col("outcome"), F.col("key_prompts")).alias("description"))


@query
def repo_roots(spark, sf):
    return R.folder_roots(A.event_sessions(spark, sf), A.event_repos(spark, sf))


@query
def page_roots(spark, sf):
    """The deepest page folder above each page's folder: every page folder is also a root."""
    key = X.folder_key(X.folder_display(F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "")))
    folders = A.table(spark, sf, "pages").select(F.lit("").alias("owner"), key.alias("folder_key")).distinct()
    roots = A.table(spark, sf, "pages").select(F.lit("").alias("owner"), F.regexp_extract("url", "^https?:/(/[^/]*)", 1).alias("root")).distinct()
    return R.folder_roots(folders, roots).select("folder_key", "root")


@query
def own_commits(spark, sf):
    kept = G.own_commits(A.event_commits(spark, sf), A.event_repos(spark, sf))
    return kept.select("owner", "repo_root", "sha", "subject", "ts")


@query
def commit_log(spark, sf):
    """Orders as log lines; lines of pending orders lack a field and are dropped."""
    line = F.concat_ws(G.SEPARATOR, F.left(F.md5(F.col("o_orderkey").cast("string")), F.lit(7)),
                       F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'-03:00'"),
                       F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    lines = A.table(spark, sf, "orders").select("o_orderkey", line.alias("value"))
    kept = G.commits_between(G.parse_log(lines), F.lit("1997-01-01").cast("timestamp"), F.lit("2000-01-01").cast("timestamp"))
    return kept.select("o_orderkey", "sha", "subject", "ts")


@query
def commits_by_day(spark, sf):
    kept = G.own_commits(A.event_commits(spark, sf), A.event_repos(spark, sf))
    return R.commits_by_day(kept, CALENDAR).groupBy("owner", "project_key", "day").agg(F.count("*").alias("commits"), F.min("ts").alias("first"))


def event_recaps(spark, sf):
    cleaned = R.clean_messages(R.merge_messages(A.event_chunks(spark, sf), CALENDAR))
    # Staged: both are read twice, and filters on what is made of a folder would else be asked of every event.
    told, repos = stage(A.event_sessions(spark, sf), "sessions"), stage(A.event_repos(spark, sf), "repos")
    placed = stage(R.session_projects(told, repos), "placed")
    recaps = stage(R.session_recaps(cleaned, placed), "recaps")
    commits = R.commits_by_day(G.own_commits(A.event_commits(spark, sf), repos), CALENDAR)
    return recaps, commits


def _project_columns(p):
    return p.select("owner", "day", "project_key", "name", "path", "session_count", "quick_count", "prompt_count", "commit_count",
                    "first_activity", "last_activity", F.array_join("branches", ",").alias("branches"), "pos")


@query
def project_recap(spark, sf):
    recaps, commits = event_recaps(spark, sf)
    return _project_columns(R.project_recaps(recaps, commits))


@query
def conversation_projects(spark, sf):
    _, _, recaps, commits = conversation_day(spark, sf)
    return _project_columns(R.project_recaps(stage(recaps, "recaps"), commits))


@query
def week_rollup(spark, sf):
    recaps, commits = event_recaps(spark, sf)
    projects = stage(R.project_recaps(recaps, commits), "projects")
    days = projects.select("owner", "day").distinct()
    rolled = R.week_rollup(R.recap_frames(days, R.every_active_day(days)), projects)
    return rolled.select("owner", "focus", "project_key", "name", "last_day", "active_days", "session_count", "quick_count", "prompt_count", "commit_count",
                         F.array_join("branches", ",").alias("branches"), "pos")


@query
def earlier_days(spark, sf):
    recaps, commits = event_recaps(spark, sf)
    return R.day_totals(R.project_recaps(recaps, commits))


@query
def headings(spark, sf):
    frames, _, projects, _ = conversation_recap(spark, sf)
    return R.headings(frames, projects).select("owner", "focus", "focus_heading", "week_heading")


@query
def recap_text(spark, sf):
    frames, recaps, projects, commits = conversation_recap(spark, sf)
    return RT.assemble(RT.day_lines(frames, recaps, projects, commits, CALENDAR)).select("owner", "focus", "text")


@query
def recap_text_slack(spark, sf):
    frames, recaps, projects, commits = conversation_recap(spark, sf)
    return RT.assemble(RT.day_lines(frames, recaps, projects, commits, CALENDAR, "slack", with_prompts=True)).select("owner", "focus", "text")


@query
def week_text(spark, sf):
    frames, recaps, projects, commits = conversation_recap(spark, sf)
    rollup = stage(R.week_rollup(frames, projects), "rollup")
    return RT.assemble(RT.week_lines(frames, rollup, recaps, projects, commits)).select("owner", "focus", "text")


@query
def summary_prompts(spark, sf):
    frames, recaps, projects, commits = conversation_recap(spark, sf)
    return RT.assemble(RT.summary_lines(frames, recaps, projects, commits, CALENDAR)).select("owner", "focus", "text")


# ---------------------------------------------------------------- merge


@query
def change_plan(spark, sf):
    stored, current = A.order_snapshots(spark, sf)
    return M.change_plan(stored, current).select("session_id", "plan", "reason", "offset")


@query
def forced_plan(spark, sf):
    stored, current = A.order_snapshots(spark, sf)
    return M.change_plan(stored, current, forced=True).groupBy("plan", "reason").agg(F.count("*").alias("n"))


@query
def prune(spark, sf):
    stored, current = A.order_snapshots(spark, sf)
    kept = M.prune(stored, current).select("session_id", F.lit("kept").alias("fate"))
    return kept.unionByName(M.pruned_sessions(stored, current).select("session_id", F.lit("pruned").alias("fate")))


@query
def upsert(spark, sf):
    stored, current = A.order_snapshots(spark, sf)
    columns = ["session_id", "size", "mtime", "head_sha256"]
    return M.upsert(stored.select(columns), current.select(columns))


def _conversation_halves(spark, sf):
    """Records of the conversations, cut at the fifth record: what was stored, and the tail."""
    records = A.conversation_records(spark, sf)
    return records.where(F.col("seq") <= 4), records.where(F.col("seq") > 4)


@query
def tail_merge(spark, sf):
    """Stored state and tail state, merged; equals the session table of all records."""
    stored, tail = (SE.session_state(r, ("session_id",)) for r in _conversation_halves(spark, sf))
    merged = M.merge_states(stored, tail).withColumn("file_name", F.concat(F.lit("conversation "), F.col("session_id")))
    return SE.finish_sessions(merged).select("session_id", "title", "title_source", "folder_display", "folder_source", "git_branch",
                                             F.col("last_prompt.text").alias("last_prompt"), "first_activity", "last_activity", "message_count", "parse_error")


@query
def derived_replace(spark, sf):
    """Chunks after a tail: its derived kinds replace the stored ones, its messages are added."""
    stored, tail = _conversation_halves(spark, sf)
    before = C.all_chunks(stored, SE.build_sessions(stored))
    after = C.all_chunks(tail, SE.build_sessions(A.conversation_records(spark, sf)).join(tail.select("session_id").distinct(), "session_id", "left_semi"))
    return M.replace_derived(before, after).select("session_id", "chunk_no", "kind", "ts", F.md5("text").alias("digest"))


@query
def full_replace(spark, sf):
    """Sessions that grew are rewritten from all their records, the others keep their chunks."""
    stored, tail = _conversation_halves(spark, sf)
    records = A.conversation_records(spark, sf)
    before = C.message_chunks(stored, ("session_id",))
    grown = tail.select("session_id").distinct()
    again = C.message_chunks(records.join(grown, "session_id", "left_semi"), ("session_id",))
    return M.replace_chunks(before, again, grown).select("session_id", "chunk_no", "kind", "ts", F.md5("text").alias("digest"))


FIRST_PASS, SECOND_PASS = "2024-02-01 00:00:00", "2024-02-02 00:00:00"


def _session_file(conv: Column) -> Column:
    return F.concat(F.lower(F.lpad(F.hex(conv), 8, "0")), F.lit("-1111-4222-8333-444455556666"))


def _transcript_records(spark, sf) -> DataFrame:
    """Conversations as records of transcripts, each one line: in a third of them tool results and meta records stand between the
    messages, and are no messages, though their text is somebody's."""
    records = A.conversation_records(spark, sf).withColumn("conv", F.col("session_id").cast("bigint"))
    extra = records.where((F.col("conv") % 3 == 0) & ((F.col("seq") - 1) % 4 == 1)).withColumns({
        "type": F.lit("user"), "has_parent": F.lit(True), "is_meta": F.col("seq") % 8 == 2, "has_tool_result": F.col("seq") % 8 != 2, "has_message": F.lit(True),
        "title_text": F.lit(None).cast("string"), "blocks": F.array(F.lit("text of a tool or of the program")), "cwd": F.lit(None).cast("string"), "git_branch": F.lit(None).cast("string")})
    both = records.withColumn("after", F.lit(0)).unionByName(extra.withColumn("after", F.lit(1)))
    line = F.row_number().over(W.partitionBy("conv").orderBy("seq", "after"))
    return both.withColumns({"turn": F.col("seq") - 1, "seq": line, "session_id": _session_file(F.col("conv"))})


def _two_passes(spark, sf):
    """An index after two passes over transcripts that tasks write from the conversations, and what became of the files in each.

    Before the second pass files are appended to, rewritten, deleted and added, and some stay as they are."""
    folder = f"{checkpoint_dir(spark)}/passes-{uuid.uuid4().hex}"
    records = stage(_transcript_records(spark, sf), "transcript-records")
    fate = F.col("conv") % 10
    head = F.col("turn") < 4
    project = F.concat(F.lit("project"), (F.col("conv") % 4).cast("string"))
    lines = lambda rows: transcripts.transcript_lines(rows.withColumn("folder", project), "folder")
    draft = records.where((fate == 7) & head).withColumn("blocks", F.array(F.lit("a draft that goes " * 40))).withColumn("type", F.lit("user")).withColumn("has_message", F.lit(True))
    transcripts.write_transcripts(lines(records.where(head & (fate != 7) & (fate != 9)).unionByName(draft)), f"{folder}/logs")
    index = SessionIndex(spark, f"{folder}/index", buckets=8)
    first = index.outcomes(f"{folder}/logs", FIRST_PASS)
    transcripts.write_transcripts(lines(records.where(~head & (fate < 6))), f"{folder}/logs", append=True)
    transcripts.write_transcripts(lines(records.where((fate == 7) | (fate == 9))), f"{folder}/logs")
    transcripts.delete_transcripts(records.where(fate == 8).select("session_id", project.alias("folder")).distinct(), f"{folder}/logs")
    return index, first, index.outcomes(f"{folder}/logs", SECOND_PASS)


@query
def pass_outcomes(spark, sf):
    _, first, second = _two_passes(spark, sf)
    both = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
    return both.groupBy("pass", "plan", "outcome").agg(F.count("*").alias("n"))


@query
def reconcile_tally(spark, sf):
    """Counts of both passes; bytes depend on how a line is written and are left to the tests."""
    _, first, second = _two_passes(spark, sf)
    both = [M.reconcile_tally(told).drop("bytes_read").withColumn("pass", F.lit(k)) for k, told in ((1, first), (2, second))]
    return both[0].unionByName(both[1])


@query
def reconcile_sessions(spark, sf):
    index, *_ = _two_passes(spark, sf)
    return index.sessions().select("session_id", "title", "title_source", "folder_display", "folder_source", "git_branch", "last_prompt", "first_activity", "last_activity", "message_count", "line_count", "parse_error")


@query
def reconcile_chunks(spark, sf):
    index, *_ = _two_passes(spark, sf)
    return index.chunks().select("session_id", "chunk_no", "kind", "ts", F.md5("text").alias("digest"))


@query
def reconcile_vocabulary(spark, sf):
    """The kept vocabulary and what the kept postings say: equal for every token."""
    index, *_ = _two_passes(spark, sf)
    found = index.search_index()
    return I.lookup(found.vocabulary.select("token"), found).groupBy("token").agg(F.count("*").alias("chunks"), F.sum("tf").alias("tf")).join(found.vocabulary, "token")


# ---------------------------------------------------------------- change streams

SETTLE_HOURS, MAX_WAIT_HOURS = 8, 20


def _changes(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.date_trunc("second", "ts").alias("ts"))


@query
def debounce(spark, sf):
    return changes.debounce(_changes(spark, sf).withColumn("key", F.substring_index("key", ":", 1)), SETTLE_HOURS * 3600, MAX_WAIT_HOURS * 3600)


@query
def throttle(spark, sf):
    return changes.throttle(_changes(spark, sf).withColumn("key", F.substring_index("key", ":", 1)), MAX_WAIT_HOURS * 3600)


def _record_stream(spark, sf):
    """Conversations as a file stream of records. The table may be a file or a folder of files: a pattern names either, a plain path only a folder."""
    schema = A.table(spark, sf, "conversations").schema
    return A.conversation_records(spark, sf, spark.readStream.schema(schema).parquet(f"{sf}/conversations.parque[t]"))


def _finish_stream(states: DataFrame) -> DataFrame:
    named = states.withColumn("file_name", F.concat(F.lit("conversation "), F.col("session_id")))
    return SE.finish_sessions(named).select("session_id", "title", "title_source", "folder_display", "git_branch", "first_activity", "last_activity", "message_count")


@query
def follow_segments(spark, sf):
    folder = f"{checkpoint_dir(spark)}/follow-{uuid.uuid4().hex}"
    follow.follow_segments(_record_stream(spark, sf), f"{folder}/states", f"{folder}/checkpoint", 8).awaitTermination()
    return _finish_stream(spark.read.parquet(f"{folder}/states"))


@query
def running_sessions(spark, sf):
    folder = f"{checkpoint_dir(spark)}/running-{uuid.uuid4().hex}"
    follow.write_updates(follow.running_sessions(_record_stream(spark, sf)), f"{folder}/updates", f"{folder}/checkpoint").awaitTermination()
    return _finish_stream(follow.latest_updates(spark, f"{folder}/updates"))
