"""Splitting, indexing and ranking on small corpora, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlens import constants as K
from sessionlens.operators import chunks as C, index as I, search as S


def cut(text):
    out, start = [], 0
    while start < len(text):
        if len(text) - start <= 8192:
            end = len(text)
        else:
            spaces = [i for i in range(start + 4096, start + 8192) if text[i] in " \t\n\r\f\v\xa0"]
            end = spaces[-1] if spaces else start + 8192
        out.append(text[start:end])
        start = end
    return [p for p in out if p.strip(" \t\n\r\f\v\xa0\x85")]


def test_split_matches_brute_force(spark):
    rng = random.Random(2)
    texts = ["", " ", "short", "x" * 8192, "x" * 8193, "x" * 20000, ("word " * 5000)[:24004], "a" * 4095 + " " + "b" * 9000, "a" * 4096 + " " + "b" * 9000, " " * 30000, "😀" * 9000]
    texts += ["".join(rng.choice("abcdef" * rng.choice([1, 30]) + " \n\t\xa0") for _ in range(rng.randint(8000, 30000))) for _ in range(12)]
    rows = spark.createDataFrame([(str(i), 1, 4, [t]) for i, t in enumerate(texts)], "session_id string, seq bigint, kind int, blocks array<string>").withColumn("ts", F.current_timestamp())
    got = {}
    for r in C.split_blocks(rows).orderBy("session_id", "chunk_no").collect():
        got.setdefault(int(r.session_id), []).append(r.text)
    for i, text in enumerate(texts):
        assert got.get(i, []) == cut(text), i


CORPUS = {
    "both": [(4, "a ladder stood crooked by the shed")],
    "apart": [(4, "the ladder is blue"), (5, "this shelf looks crooked to me")],
    "one": [(4, "a ladder of seven rungs")],
    "key": [(4, "spool KLM-1234 is empty")],
    "loose": [(4, "klm came first and 123 came last")],
    "report": [(4, "an upholstery catalogue")],
    "accent": [(4, "un almacén cerrado")],
    "titled": [(1, "varnish")],
    "chatty": [(5, f"varnish {i}") for i in range(40)],
    "path": [(2, "D:\\sheds\\North main")],
    "cafe": [(4, "Un CAFE\u0301 noir, s'il vous plaît")],
}


@pytest.fixture(scope="module")
def corpus(spark):
    flat = [(s, n, kind, text) for s, parts in CORPUS.items() for n, (kind, text) in enumerate(parts)]
    chunks = spark.createDataFrame(flat, "session_id string, chunk_no bigint, kind int, text string")
    sessions = spark.createDataFrame([(s, s) for s in CORPUS], "session_id string, title string").withColumn("last_activity", F.lit("2026-10-01").cast("timestamp"))
    return chunks, sessions, I.build_index(chunks)


def find(spark, corpus, texts, ranking=S.Ranking()):
    chunks, sessions, index = corpus
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    rows = S.search(queries, index, sessions, chunks, F.lit("2026-10-05").cast("timestamp"), ranking).orderBy("query_id", "rank").collect()
    return {t: [r for r in rows if r.query_id == i] for i, t in enumerate(texts)}


def ids(rows):
    return [r.session_id for r in rows]


def test_search_semantics(spark, corpus):
    texts = ["ladder crooked", "crooked ladder ladder Láddér", "klm-123", "upholst", "almacen", "almacén", "D:\\sheds\\North", "widgetless", "cafe", "pholstery", "l c", '"klm']
    found = find(spark, corpus, texts)
    assert ids(found["ladder crooked"]) == ["both", "apart"]
    assert ids(found["crooked ladder ladder Láddér"]) == ["both", "apart"]
    assert ids(found["klm-123"]) == ["key"]
    assert ids(found["upholst"]) == ["report"]
    assert ids(found["almacen"]) == ids(found["almacén"]) == ["accent"]
    assert ids(found["D:\\sheds\\North"]) == ["path"]
    assert ids(found["widgetless"]) == ids(found["pholstery"]) == []
    assert ids(found["cafe"]) == ["cafe"]
    assert set(ids(found["l c"])) >= {"both", "apart"}
    assert set(ids(found['"klm'])) == {"key", "loose"}
    assert found["upholst"][0].snippet == "an [upholstery] catalogue"
    assert found["klm-123"][0].snippet == "spool [KLM-1234] is empty"
    assert found["cafe"][0].snippet == "Un [CAFE\u0301] noir, s'il vous plaît"
    assert found["ladder crooked"][1].matched_kinds == [4, 5]


def test_repeat_weight(spark, corpus):
    assert ids(find(spark, corpus, ["varnish"])["varnish"]) == ["titled", "chatty"]
    assert ids(find(spark, corpus, ["varnish"], S.Ranking(repeat=1.0))["varnish"]) == ["chatty", "titled"]


def test_nothing_to_search_for(spark, corpus):
    texts = ["", " ", "a", "*", '"', "( -", "^:", "NOT", '"unbalanced', "a b"]
    found = find(spark, corpus, texts, S.Ranking(results=5))
    for text in ("", " ", "a", "*", '"', "( -", "^:"):
        assert len(found[text]) == 5 and all(r.is_recent and r.lexical_score == 0 and r.snippet is None for r in found[text])
        assert found[text][0].score == (0.0 if len(text.strip()) >= 2 else found[text][0].recency)
    for text in ("NOT", '"unbalanced', "a b"):
        assert not any(r.is_recent for r in found[text])


def test_a_batch_equals_single_searches(spark, corpus):
    texts = ["ladder crooked", "varnish", "the", "klm-123"]
    batch = find(spark, corpus, texts)
    for text in texts[:2]:
        single = find(spark, corpus, [text])[text]
        assert [tuple(r)[1:] for r in single] == [tuple(r)[1:] for r in batch[text]]


def test_phrases_match_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "ab", "abc", "c"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    chunks = spark.createDataFrame([(str(i), 0, 4, t) for i, t in enumerate(texts)], "session_id string, chunk_no bigint, kind int, text string")
    phrases = ["a", "ab", "a b", "a a", "a a b", "ab ab a", "b c ab abc", "zz a", "a zz", "c c c c"]
    terms = spark.createDataFrame([(p, p.split(" ")) for p in phrases], "term string, tokens array<string>")
    got = {(r.term, int(r.session_id)): r.tf for r in I.term_hits(terms, I.build_index(chunks)).collect()}
    want = {}
    for p in phrases:
        parts = p.split(" ")
        for i, t in enumerate(texts):
            words = t.split(" ")
            n = sum(words[k:k + len(parts) - 1] == parts[:-1] and words[k + len(parts) - 1].startswith(parts[-1]) for k in range(len(words) - len(parts) + 1))
            if n:
                want[p, i] = n
    assert got == want


def test_a_written_index_answers_the_same(spark, corpus, tmp_path):
    _, _, index = corpus
    I.write_index(index, str(tmp_path / "ix"))
    stored = I.read_index(spark, str(tmp_path / "ix"))
    terms = spark.createDataFrame([("varn", ["varn"]), ("the ladder", ["the", "ladder"])], "term string, tokens array<string>")
    both = [sorted(map(tuple, I.term_hits(terms, ix).collect())) for ix in (index, stored)]
    assert both[0] == both[1] and both[0]
    plan = I.lookup(terms.select("term", F.col("term").alias("token")), stored)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "dynamicpruning" in plan


def test_sweep_prefers_the_labelled_session(spark, corpus):
    _, sessions, index = corpus
    queries = spark.createDataFrame([(1, "varnish"), (2, "ladder crooked")], "query_id int, text string")
    labels = spark.createDataFrame([(1, "titled"), (2, "both")], "query_id int, session_id string")
    settings = spark.createDataFrame([("plain", 2.0, 0.0), ("repeat", 2.0, 1.0)], "setting string, co_occurrence double, repeat double")
    rows = {r.setting: r for r in S.weight_sweep(queries, labels, index, sessions, F.lit("2026-10-05").cast("timestamp"), settings).collect()}
    assert rows["plain"].mean_rank == 1.0 and rows["repeat"].mean_rank == 1.5 and rows["plain"].queries == 2


def test_postings_of_many_chunks(spark):
    """Positions per token and chunk, beyond the number of chunks a task takes at once; chunks without tokens give none."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "ab", "abc", "zürich", "x1"]) for _ in range(rng.randint(0, 12))) for _ in range(2 * I.CHUNKS_AT_ONCE + 7)]
    chunks = spark.createDataFrame([(str(i), i % 3, 4, text) for i, text in enumerate(texts)], "session_id string, chunk_no bigint, kind int, text string").coalesce(1)
    want = {}
    for i, text in enumerate(texts):
        for k, word in enumerate(text.replace("ü", "u").split()):
            want.setdefault((word, str(i), i % 3, 4, len(text.split())), []).append(k)
    got = I.build_postings(I.forward_index(chunks)).collect()
    assert len(got) == len(want) and {tuple(r[:5]): list(r.positions) for r in got} == want and all(r.tf == len(r.positions) for r in got)
    counted = {r.token: r.df for r in I.forward_vocabulary(I.forward_index(chunks)).collect()}
    assert counted == {w: sum(k[0] == w for k in want) for w in {k[0] for k in want}}


def test_postings_make_token_lists_once(spark):
    """A filter on the token lists would be asked below their projection, and make all of them a second time."""
    chunks = spark.createDataFrame([("s", 1, 4, "one two"), ("s", 2, 4, "..."), ("s", 3, 4, None)], "session_id string, chunk_no bigint, kind int, text string")
    made = I.build_postings(I.forward_index(chunks))
    assert made._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1
    assert sorted((r.token, r.chunk_no, r.tf) for r in made.collect()) == [("one", 1, 1), ("two", 1, 1)]


def test_hits_of_a_staged_index_deal_out_no_positions(spark, corpus):
    """Terms meet the postings and phrases the token lists where they lie: the only shuffles are of hits, by their keys."""
    queries = spark.createDataFrame([(1, "lad cro"), (2, "KLM-1234 spool")], "query_id int, text string")
    hits = I.term_hits(I.distinct_terms(I.query_terms(queries)), corpus[2])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "SortMergeJoin" not in plan and "positions" not in plan and shuffles and all("(term" in line and "chunk_no" in line for line in shuffles)
    assert {(r.term, r.session_id, r.tf) for r in hits.collect()} == {
        ("lad", "both", 1), ("lad", "apart", 1), ("lad", "one", 1), ("cro", "both", 1), ("cro", "apart", 1), ("klm 1234", "key", 1), ("spool", "key", 1)}


def test_single_terms_shuffle_nothing(spark, monkeypatch):
    """Prefix hits are made where the token lists lie, whatever tokens are neighbours, and equal those of the join that takes over where terms are too many to send."""
    rng = random.Random(7)
    words = ["a", "ab", "abc", "abcd", "abcde", "abd", "b", "ñu", "ñusta", "zoé", "zoë", "\U0001f600", "ÿ", "z"]
    rows = [(str(i % 40), i, 4, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(1300)]
    index = I.build_index(spark.createDataFrame([*rows, ("x", 9999, 4, "?!")], "session_id string, chunk_no bigint, kind int, text string"))
    asked = ["a", "ab", "abcd", "abcdef", "b", "n", "nu", "zoe", "y", "q", ""]
    terms = spark.createDataFrame([(t, [t]) for t in asked], "term string, tokens array<string>")
    hits = I.single_hits(terms, index)
    assert "Exchange" not in hits._jdf.queryExecution().toString()
    want = {}
    for r in index.forward.collect():
        for t in asked:
            tf = sum(w.startswith(t) for w in r.tokens)
            if t and tf:
                want[t, r.session_id, r.chunk_no, r.kind, len(r.tokens)] = tf
    assert {tuple(r)[:5]: r.tf for r in hits.collect()} == want and len(want) > 3000
    monkeypatch.setattr(I, "TERMS_AT_ONCE", 3)
    assert sorted(map(str, I.single_hits(terms, index).collect())) == sorted(map(str, hits.collect()))
    monkeypatch.setattr(I, "MOST_SENT", 0)
    joined = I.single_hits(terms, index)
    assert "Exchange" in joined._jdf.queryExecution().toString()
    assert sorted(map(str, joined.collect())) == sorted(map(str, hits.collect())) and joined.schema == hits.schema


def test_candidates_alone_are_looked_up(spark, monkeypatch):
    """Sessions qualify by hits of the rarest term; hits of no candidate are not staged or dealt out."""
    hits = spark.createDataFrame([("often", str(s), c) for s in range(50) for c in range(3)] + [("rare", "7", 1), ("rare", "99", 0), ("other", "7", 2)], "term string, session_id string, chunk_no bigint")
    terms = spark.createDataFrame([(1, 2, "often"), (1, 2, "rare"), (2, 3, "often"), (2, 3, "rare"), (2, 3, "none"), (3, 1, "other")], "query_id int, n_terms int, term string")
    staged = {}
    monkeypatch.setattr(S, "stage", lambda df, name: staged.setdefault(name, df.cache()))
    assert {tuple(r) for r in S.qualified_sessions(terms, hits).collect()} == {(1, "7"), (3, "7")}
    assert max(df.count() for df in staged.values()) <= 5
