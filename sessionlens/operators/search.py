"""Batch search: a table of queries against an index.

Every typed term must occur somewhere in a session, not necessarily in one chunk. Chunks are scored
by BM25 summed over terms, weighted by kind and multiplied up when several terms share a chunk; a
session scores by its strongest chunk. The best candidates are re-ranked by recency.

All scores are rounded to nine decimals where they are compared, so that ties do not depend on the
order partial sums arrive in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sessionlens import constants as K
from sessionlens.functions import scoring, text as X
from sessionlens.session import stage
from sessionlens.operators.index import Index, corpus_size, distinct_terms, phrase_matches, query_terms, term_hits

SCALE = 9
#: What a hit tells about its session besides title and time. Session tables that lack one give null.
HIT_COLUMNS = {"folder_display": "string", "git_branch": "string", "file_path": "string", "message_count": "bigint"}


def session_facts(sessions: DataFrame) -> DataFrame:
    """The columns of sessions that a hit shows."""
    facts = [F.col(c) if c in sessions.columns else F.lit(None).cast(kind).alias(c) for c, kind in HIT_COLUMNS.items()]
    return sessions.select("session_id", "title", "last_activity", *facts)


@dataclass(frozen=True)
class Ranking:
    """Tunable weights, with the defaults of the data model."""

    kind_weights: dict[int, float] = field(default_factory=lambda: dict(K.KIND_WEIGHTS))
    co_occurrence: float = K.CO_OCCURRENCE_WEIGHT
    repeat: float = K.REPEAT_WEIGHT
    recency_weight: float = K.RECENCY_WEIGHT
    recency_decay_days: float = K.RECENCY_DECAY_DAYS
    candidates: int = K.CANDIDATE_LIMIT
    results: int = K.RESULT_LIMIT


def relevance(hits: DataFrame, index: Index) -> DataFrame:
    """Adds BM25 relevance to hits, which are read twice. Document frequency counts chunks, prefix expansion included."""
    size = corpus_size(index)
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    weights = frequency.select("term", scoring.idf(size.select("n_chunks").scalar(), F.col("df")).alias("idf"))
    score = scoring.bm25(F.col("tf"), F.col("n_tokens"), size.select("mean_length").scalar(), F.col("idf"))
    # One row per term: staged, so that the hits need not be dealt out by term to meet it.
    weights = stage(weights, "weights")
    return hits.join(weights, "term").select("term", "session_id", "chunk_no", "kind", score.alias("relevance"))


def qualified_sessions(terms: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, session_id)`` where every term of the query was found somewhere in the session.

    Only sessions that hold a query's rarest term are candidates, and only for these are the other terms looked up, so a frequent term
    in many queries costs no more than the candidates it is checked for. Hits are read three times; only those of candidates are shuffled.
    """
    counts = hits.groupBy("term").agg(F.count("*").alias("hits"))
    spread = terms.join(counts, "term", "left").select("query_id", "n_terms", "term", F.coalesce("hits", F.lit(0)).alias("hits"))
    # Staged, as are the pairs, so that their size is known: small ones are sent to the hits.
    rarest = stage(spread.groupBy("query_id", "n_terms").agg(F.min(F.struct("hits", "term"))["term"].alias("term")), "rarest")
    candidates = hits.select("term", "session_id").join(rarest, "term").select("query_id", "session_id", "n_terms").distinct()
    asked = stage(candidates.join(terms.select("query_id", "term"), "query_id"), "asked")
    pairs = stage(asked.select("term", "session_id").distinct(), "pairs")
    found = hits.select("term", "session_id").join(pairs, ["term", "session_id"], "left_semi").distinct()
    held = asked.join(found, ["term", "session_id"])
    complete = held.groupBy("query_id", "session_id", "n_terms").agg(F.count("*").alias("n")).where(F.col("n") == F.col("n_terms"))
    return complete.select("query_id", "session_id")


def chunk_scores(matches: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """One row per (query, chunk): weighted score and the term that matched it best."""
    return (
        matches.groupBy("query_id", "session_id", "chunk_no", "kind")
        .agg(
            F.sum("relevance").alias("total"),
            F.count("*").alias("terms"),
            F.min(F.struct((-F.round("relevance", SCALE)).alias("r"), "term_no", "term"))["term"].alias("best_term"),
        )
        .select(
            "query_id", "session_id", "chunk_no", "kind", "terms", "best_term", "total",
            F.round(
                F.col("total") * scoring.kind_weight(F.col("kind"), ranking.kind_weights)
                * (1 + F.lit(ranking.co_occurrence) * (F.col("terms") - 1)),
                SCALE,
            ).alias("weighted"),
        )
    )


def session_scores(scored_chunks: DataFrame, repeat: Column | float = K.REPEAT_WEIGHT, keys: tuple[str, ...] = ("query_id", "session_id")) -> DataFrame:
    """One row per (query, session): score, matched chunks and kinds, and the strongest chunk.

    All parts are partial aggregates, the strongest chunk included: no per-session sort.
    """
    repeat = repeat if isinstance(repeat, Column) else F.lit(repeat)
    strength = F.struct(F.col("weighted"), (-F.col("chunk_no")).alias("o"), F.col("best_term"))
    grouped = scored_chunks.groupBy(*keys).agg(
        F.max("weighted").alias("top"),
        F.sum("weighted").alias("total"),
        F.count("*").alias("match_count"),
        F.array_sort(F.collect_set("kind")).alias("matched_kinds"),
        F.max(strength).alias("best"),
    )
    return grouped.select(
        *keys,
        F.round(F.col("top") + repeat * (F.col("total") - F.col("top")), SCALE).alias("lexical_score"),
        "match_count",
        F.filter("matched_kinds", lambda k: k.isin(*K.KINDS)).alias("matched_kinds"),
        (-F.col("best.o")).alias("chunk_no"),
        F.col("best.best_term").alias("term"),
    )


def rank_sessions(scores: DataFrame, sessions: DataFrame, now: Column, ranking: Ranking = Ranking()) -> DataFrame:
    """Cut to the best candidates, re-rank by recency, keep the results."""
    by_score = W.partitionBy("query_id").orderBy(F.col("lexical_score").desc(), F.col("session_id"))
    cut = scores.withColumn("candidate", F.row_number().over(by_score)).where(F.col("candidate") <= ranking.candidates).drop("candidate")
    boosted = (
        cut.join(session_facts(sessions), "session_id")
        .withColumn("recency", scoring.recency_multiplier(F.col("last_activity"), now, ranking.recency_weight, ranking.recency_decay_days))
        .withColumn("score", F.round(F.col("lexical_score") * F.col("recency"), SCALE))
    )
    final = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("last_activity").desc_nulls_last(), F.col("session_id"))
    return boosted.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= ranking.results)


def with_snippets(rows: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """Adds ``snippet``: the 12-token window with most hits of the term, hits in brackets, cut ends marked.

    Built column by column: each step is used several times by the next, so it is computed once.
    """
    kept = rows.columns
    size, n = F.size("_words"), F.size("_phrase")

    def inside(start: Column) -> Column:
        return F.filter("_hits", lambda h: (h >= start) & (h + n <= start + K.SNIPPET_TOKENS))

    def shown(i: Column) -> Column:
        opened = F.when(F.array_contains("_hits", i), F.lit("[")).otherwise(F.lit(""))
        closed = F.when(F.array_contains("_hits", i - n + 1), F.lit("]")).otherwise(F.lit(""))
        gap = F.when(i + 1 < F.col("_end"), F.get("_gaps", i + 1)).otherwise(F.lit(""))
        return F.concat(opened, F.get("_words", i), closed, gap)

    # Most hits first, then the earliest; the window is centred on the hits it holds.
    best = F.array_max(F.transform("_hits", lambda h: F.struct(F.size(inside(h)).alias("c"), (-h).alias("o"))))
    centred = F.col("_first") - F.floor((F.lit(K.SNIPPET_TOKENS) - (F.col("_last") - F.col("_first"))) / 2).cast("int")
    split = rows.withColumns({
        "_words": F.regexp_extract_all(F.col(text), F.lit(X.RAW_TOKEN), F.lit(0)),
        "_gaps": F.split(F.col(text), X.RAW_TOKEN),
        "_phrase": F.split(F.col(term), " "),
    })
    # The text is folded once; word by word only where a lone mark makes the two token lists differ.
    whole = split.withColumn("_tokens", X.tokens(F.col(text)))
    aligned = F.when(F.size("_tokens") == size, F.col("_tokens")).otherwise(F.transform("_words", X.fold))
    found = whole.withColumn("_folded", aligned).withColumn("_hits", phrase_matches(F.col("_folded"), F.col("_phrase")))
    framed = (
        found.withColumn("_first", -best["o"])
        .withColumn("_last", F.coalesce(F.array_max(inside(F.col("_first"))), F.col("_first")) + n)
        .withColumn("_start", F.greatest(F.lit(0), F.least(centred, size - K.SNIPPET_TOKENS)))
        .withColumn("_end", F.least(F.col("_start") + K.SNIPPET_TOKENS, size))
    )
    body = F.array_join(F.transform(F.sequence(F.col("_start"), F.col("_end") - 1), shown), "")
    return framed.select(*kept, F.concat(
        F.when(F.col("_start") > 0, F.lit(K.ELLIPSIS)).otherwise(F.get("_gaps", F.lit(0))),
        body,
        F.when(F.col("_end") < size, F.lit(K.ELLIPSIS)).otherwise(F.get("_gaps", size)),
    ).alias("snippet"))


def add_snippets(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Snippet of each result's strongest chunk; text is joined for the results only."""
    return with_snippets(ranked.join(chunks.select("session_id", "chunk_no", "text"), ["session_id", "chunk_no"])).drop("text")


def is_recent_query() -> Column:
    """Too short to search with, or nothing in it to search for."""
    text = F.regexp_replace("text", r"^[\p{Z}\s\x{85}]+|[\p{Z}\s\x{85}]+$", "")
    return (F.length(text) < K.MINIMUM_QUERY_LENGTH) | ~F.rlike(text, F.lit(X.SEARCHABLE))


def recent_mode(queries: DataFrame, sessions: DataFrame, now: Column, ranking: Ranking = Ranking()) -> DataFrame:
    """Recent sessions for every query there is nothing to search for. The listing (at most
    ``ranking.results`` rows) travels as one array value."""
    newest = (
        session_facts(sessions)
        .orderBy(F.col("last_activity").desc_nulls_last(), F.col("session_id")).limit(ranking.results)
        .withColumn("recency", scoring.recency_multiplier(F.col("last_activity"), now, ranking.recency_weight, ranking.recency_decay_days))
    )
    newest_key = F.coalesce(-F.unix_micros("last_activity"), F.lit(2**63 - 1))
    ordered = F.array_sort(F.collect_list(F.struct(newest_key.alias("k"), "session_id", "title", "last_activity", "recency", *HIT_COLUMNS)))
    listing = newest.agg(ordered.alias("listing")).scalar()
    text = F.regexp_replace("text", r"^[\p{Z}\s\x{85}]+|[\p{Z}\s\x{85}]+$", "")
    return (
        queries.where(is_recent_query())
        .select("query_id", (F.length(text) < K.MINIMUM_QUERY_LENGTH).alias("short"), F.posexplode(listing).alias("i", "s"))
        .select(
            "query_id", F.col("s.session_id").alias("session_id"), F.col("s.title").alias("title"),
            F.col("s.last_activity").alias("last_activity"), *[F.col(f"s.{c}").alias(c) for c in HIT_COLUMNS],
            F.lit(0.0).alias("lexical_score"), F.col("s.recency").alias("recency"),
            F.when(F.col("short"), F.col("s.recency")).otherwise(F.lit(0.0)).alias("score"),
            F.lit(0).cast("bigint").alias("match_count"),
            F.array().cast("array<int>").alias("matched_kinds"),
            (F.col("i") + 1).alias("rank"), F.lit(None).cast("string").alias("snippet"), F.lit(True).alias("is_recent"),
        )
    )


def scored_chunks(queries: DataFrame, index: Index, ranking: Ranking = Ranking()) -> DataFrame:
    """Chunk scores of the sessions that answer to every term."""
    terms = query_terms(queries)
    # Hits are read for document frequencies, for qualification and for scoring.
    hits = stage(term_hits(distinct_terms(terms), index), "hits")
    qualified = stage(qualified_sessions(terms, hits), "qualified")
    wanted = stage(qualified.join(terms, "query_id"), "wanted")
    kept = wanted.join(relevance(hits, index), ["term", "session_id"])
    return chunk_scores(kept, ranking)


def search(queries: DataFrame, index: Index, sessions: DataFrame, chunks: DataFrame, now: Column, ranking: Ranking = Ranking()) -> DataFrame:
    """Results of every query in the table, best first; recent sessions where there is nothing to search."""
    scores = session_scores(scored_chunks(queries, index, ranking), ranking.repeat)
    ranked = add_snippets(rank_sessions(scores, sessions, now, ranking), chunks).withColumn("is_recent", F.lit(False))
    recent = recent_mode(queries, sessions, now, ranking)
    return ranked.select(recent.columns).unionByName(recent)


def weight_sweep(queries: DataFrame, labels: DataFrame, index: Index, sessions: DataFrame, now: Column, settings: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """Mean rank and mean reciprocal rank of the right session per (co_occurrence, repeat) setting.

    Only the ``ranking.candidates`` best sessions of a query are ranked, as in a search; a right answer that is cut does not count.

    Hits are scored once; the settings multiply only the small per-chunk score rows.
    ``labels`` holds ``(query_id, session_id)`` of right answers; the best-ranked one counts.
    """
    base = scored_chunks(queries, index, Ranking(kind_weights=ranking.kind_weights, co_occurrence=0.0))
    grid = settings.agg(F.collect_list(F.struct("setting", "co_occurrence", "repeat"))).scalar()
    spread = base.select("*", F.explode(grid).alias("g"))
    weighted = spread.withColumn("weighted", F.round(
        F.col("total") * scoring.kind_weight(F.col("kind"), ranking.kind_weights)
        * (1 + F.col("g.co_occurrence") * (F.col("terms") - 1)), SCALE))
    keyed = weighted.select("query_id", "session_id", "chunk_no", "kind", "best_term", "weighted",
                            F.col("g.setting").alias("setting"), F.col("g.repeat").alias("repeat"))
    scores = session_scores(keyed, F.col("repeat"), ("setting", "repeat", "query_id", "session_id"))
    by_score = W.partitionBy("setting", "query_id").orderBy(F.col("lexical_score").desc(), F.col("session_id"))
    cut = scores.withColumn("candidate", F.row_number().over(by_score)).where(F.col("candidate") <= ranking.candidates)
    boosted = cut.join(sessions.select("session_id", "last_activity"), "session_id").withColumn(
        "score", F.round(F.col("lexical_score") * scoring.recency_multiplier(F.col("last_activity"), now, ranking.recency_weight, ranking.recency_decay_days), SCALE))
    # A right answer's rank is one more than the number of sessions ahead of it.
    right = boosted.join(labels, ["query_id", "session_id"], "left_semi").groupBy("setting", "query_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "session_id")).alias("r"))
    ahead = boosted.join(right, ["setting", "query_id"]).where(
        F.struct((-F.col("score")).alias("s"), F.col("session_id")) <= F.col("r"))
    ranks = ahead.groupBy("setting", "query_id").agg(F.count("*").alias("rank"))
    return ranks.groupBy("setting").agg(
        F.count("*").alias("queries"), F.avg("rank").alias("mean_rank"), F.avg(1.0 / F.col("rank")).alias("mean_reciprocal_rank"))
