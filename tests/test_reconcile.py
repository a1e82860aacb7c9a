"""Incremental passes: whatever the order of changes, the tables equal a rebuild from scratch."""

import io
import os
import random

import pytest
import transcripts as t
from pyspark.sql import functions as F

from sessionlens.plans.reconcile import SessionIndex
from sessionlens.sources import sinks, transcripts as R

SESSION = ["session_id", "title", "title_source", "folder_display", "folder_source", "git_branch", "last_prompt", "first_activity",
           "last_activity", "message_count", "file_size", "head_sha256", "parse_offset", "parse_error"]


def tables(index: SessionIndex):
    sessions = sorted(map(tuple, index.sessions().select(*SESSION).collect()))
    chunks = sorted(map(tuple, index.chunks().select("session_id", "chunk_no", "kind", F.col("ts").cast("string"), "text").collect()), key=str)
    found = index.search_index()
    postings = sorted(map(tuple, found.alive(found.postings).select("token", "session_id", "chunk_no", "tf").collect()))
    return sessions, chunks, postings


def rebuilt(spark, root, tmp_path, name):
    fresh = SessionIndex(spark, str(tmp_path / name), buckets=4)
    fresh.reconcile(str(root), "2026-03-03 00:00:00")
    return tables(fresh)


def touch(path, seconds):
    stat = path.stat()
    os.utime(path, (stat.st_atime, stat.st_mtime + seconds))


def test_passes_equal_a_rebuild(spark, tmp_path):
    root = tmp_path / "logs"
    paths = {n: t.write(root, n, t.lines(t.user(f"prompt {n}", n, root=True), t.assistant(f"answer {n} depósito", n + 1))) for n in range(1, 7)}
    t.write(root, 6, '{"type":"custom-ti', append=True)
    t.write(root, 8, "")
    index = SessionIndex(spark, str(tmp_path / "index"), buckets=4)
    first = index.reconcile(str(root), "2026-03-02 12:00:00").first()
    assert (first.discovered, first.indexed, first.skipped, first.pruned) == (7, 7, 0, 0)
    assert first.chunks_written == 6 * 4 + 1

    again = index.reconcile(str(root), "2026-03-02 13:00:00").first()
    assert (again.indexed, again.skipped, again.chunks_written) == (0, 7, 0)
    assert index.meta().first().completed_at.hour == 13

    t.write(root, 1, t.lines(t.user("more words", 20), t.title("custom-title", "Named late"), t.title("last-prompt", "go on")), append=True)
    t.write(root, 2, t.lines(t.title("ai-title", "Only a title")), append=True)
    paths[3].write_text(t.lines(t.user("rewritten from scratch", 3, root=True, cwd="/new"), t.user("and longer than before " + "w" * 500, 5)))
    paths[4].write_text(t.lines(t.user("short", 4)))
    paths[5].unlink()
    t.write(root, 6, 'tle","customTitle":"Finished line"}\nnot json\n', append=True)
    t.write(root, 7, t.lines(t.user("brand new", 7, root=True)))
    for n in (1, 2, 3, 4, 6):
        touch(paths[n], 60)
    plan = {r.session_id: (r.plan, r.reason) for r in index.plan(str(root)).collect()}
    assert plan == {t.session_id(1): ("resume", None), t.session_id(2): ("resume", None), t.session_id(3): ("full", "head_changed"),
                    t.session_id(4): ("full", "file_truncated"), t.session_id(5): ("prune", None), t.session_id(6): ("resume", None), t.session_id(7): ("full", "never_indexed"), t.session_id(8): ("skip", None)}
    tally = index.reconcile(str(root), "2026-03-03 00:00:00").first()
    assert (tally.discovered, tally.indexed, tally.skipped, tally.pruned, tally.parse_errors) == (7, 6, 1, 1, 1)
    assert tables(index) == rebuilt(spark, root, tmp_path, "fresh")


def test_random_appends_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(7)
    root, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=4)
    minute = 0
    for step in range(3):
        for n in range(1, 5):
            parts = []
            for _ in range(rng.randint(0, 3)):
                minute += 1
                parts.append(rng.choice([
                    t.user(f"ask {minute}", minute, root=rng.random() < 0.3, cwd=rng.choice(["/a", "/b/", None]), branch=rng.choice(["main", None])),
                    t.assistant(f"say {minute}", minute), t.title("ai-title", f"T{minute}"), t.title("custom-title", f"C{minute}"),
                    t.user([{"type": "tool_result"}], minute, toolUseResult={}), "junk"]))
            path = t.write(root, n, t.lines(*parts), append=True)
            touch(path, step * 60)
        index.reconcile(str(root), "2026-03-03 00:00:00")
    assert tables(index) == rebuilt(spark, root, tmp_path, "fresh")
    forced = index.reconcile(str(root), "2026-03-03 00:00:00", forced=True).first()
    assert forced.indexed == 4 and tables(index) == rebuilt(spark, root, tmp_path, "fresh2")


def grown(root):
    paths = {n: t.write(root, n, t.lines(t.user(f"prompt {n}", n, root=True), t.assistant(f"answer {n}", n + 1))) for n in range(1, 4)}
    return paths


@pytest.mark.parametrize("fails_at", [1, 3, 5, 6])
def test_a_pass_that_fails_changes_nothing(spark, tmp_path, monkeypatch, fails_at):
    root, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2)
    paths = grown(root)
    index.reconcile(str(root), "2026-03-02 12:00:00")
    before = tables(index)
    t.write(root, 1, t.lines(t.user("one more", 9)), append=True)
    touch(paths[1], 60)
    paths[2].unlink()
    calls = []
    for name in ("write", "commit"):
        real = getattr(sinks.Versions, name)

        def failing(self, *args, real=real):
            calls.append(1)
            if len(calls) == fails_at:
                raise OSError("injected")
            return real(self, *args)

        monkeypatch.setattr(sinks.Versions, name, failing)
    with pytest.raises(OSError, match="injected"):
        index.reconcile(str(root), "2026-03-02 13:00:00")
    monkeypatch.undo()
    assert tables(index) == before and index.meta().first().completed_at.hour == 12
    tally = index.reconcile(str(root), "2026-03-02 14:00:00").first()
    assert (tally.indexed, tally.pruned) == (1, 1) and tables(index) == rebuilt(spark, root, tmp_path, "fresh")


def test_folder_names_may_hold_anything(spark, tmp_path):
    root, index = tmp_path / "my logs %20 [x]", SessionIndex(spark, str(tmp_path / "index"), buckets=2)
    for n, project in enumerate(["a b", "c%20d", "e[f]", "g{h,i}", "j*k", "l#m", "ñ"], start=1):
        t.write(root, n, t.lines(t.user(f"prompt {n}", n, root=True)), project=project)
    assert index.reconcile(str(root), "2026-03-02 12:00:00").first().indexed == 7
    t.write(root, 3, t.lines(t.user("again", 9)), project="e[f]", append=True)
    tally = index.reconcile(str(root), "2026-03-02 13:00:00").first()
    assert (tally.indexed, tally.skipped) == (1, 6) and index.chunks().where("kind = 4").count() == 8


def test_empty_root_and_last_file_gone(spark, tmp_path):
    root, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2)
    assert index.reconcile(str(root), "2026-03-02 12:00:00").first().discovered == 0
    path = t.write(root, 1, t.lines(t.user("prompt", 1, root=True)))
    index.reconcile(str(root), "2026-03-02 12:00:00")
    path.unlink()
    assert index.reconcile(str(root), "2026-03-02 13:00:00").first().pruned == 1
    assert tables(index) == ([], [], [])


def test_files_that_go_or_break_during_a_pass(spark, tmp_path, monkeypatch):
    root, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2)
    paths = grown(root)
    real = R.head_hashes

    def later(files):
        hashed = spark.createDataFrame(real(files).collect(), real(files).schema)
        paths[2].unlink()
        paths[3].write_text("cut short")
        return hashed

    monkeypatch.setattr(R, "head_hashes", later)
    tally = index.reconcile(str(root), "2026-03-02 12:00:00").first()
    assert (tally.discovered, tally.indexed, tally.skipped, tally.failed) == (3, 1, 1, 1)
    assert [r.session_id for r in index.sessions().collect()] == [t.session_id(1)]
    monkeypatch.undo()
    tally = index.reconcile(str(root), "2026-03-02 13:00:00").first()
    assert (tally.indexed, tally.skipped) == (1, 1)


def test_ranges_give_every_line_once_and_read_the_tail_only():
    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            data = super().read(size)
            Counted.n += len(data)
            return data

    rng = random.Random(3)
    data = b"".join(bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 40]))) + b"\n" for _ in range(200)) + b"unfinished"
    whole = list(R.lines_from(io.BytesIO(data), 0, len(data), 0, len(data)))
    assert [line for _, line in whole] == data.split(b"\n")[:-1]
    for width in (1, 7, 64, 1000):
        parts = [x for s in range(0, len(data), width) for x in R.lines_from(io.BytesIO(data), s, min(s + width, len(data)), 0, len(data), piece=13)]
        assert parts == whole
    offset = whole[150][0]
    assert list(R.lines_from(Counted(data), offset, len(data), offset, len(data))) == whole[150:] and Counted.n == len(data) - offset


def test_of_two_interleaved_passes_none_loses_rows(spark, tmp_path, monkeypatch):
    root, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2)
    paths = grown(root)
    index.reconcile(str(root), "2026-03-02 12:00:00")
    t.write(root, 1, t.lines(t.user("first writer", 9)), append=True)
    touch(paths[1], 60)
    real, others = sinks.Versions.commit, []

    def commit(self, base, *rest):
        if not others:
            # Before this pass is made current, another one reads the same base, sees one more change and comes first.
            others.append(1)
            t.write(root, 2, t.lines(t.user("second writer", 9)), append=True)
            touch(paths[2], 60)
            SessionIndex(spark, str(tmp_path / "index"), buckets=2).reconcile(str(root), "2026-03-02 13:00:00")
        others.append(base["number"])
        return real(self, base, *rest)

    monkeypatch.setattr(sinks.Versions, "commit", commit)
    index.reconcile(str(root), "2026-03-02 14:00:00")
    monkeypatch.undo()
    assert others[1:] == [1, 1, 2] and index.version()["number"] == 3
    assert tables(index) == rebuilt(spark, root, tmp_path, "fresh")
    # Without another attempt the pass that comes second says so.
    base = index.version()
    index.tables.commit(base, "2026-03-02 15:00:00", base["tables"], base["totals"])
    with pytest.raises(sinks.Conflict):
        index.tables.commit(base, "2026-03-02 15:00:00", base["tables"], base["totals"])


def folders(index, table):
    return sorted(index.tables._entries(f"{index.path}/{table}"))


def test_readers_keep_what_they_opened_and_old_segments_go_in_the_end(spark, tmp_path):
    root, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2, most_dead=0.0)
    paths = grown(root)
    index.reconcile(str(root), "2026-03-02 12:00:00")
    opened, before = index.chunks(), index.chunks().count()
    for k in range(2):
        t.write(root, 1, t.lines(t.user(f"again {k}", 9 + k)), append=True)
        touch(paths[1], 60 * (k + 1))
        index.reconcile(str(root), "2026-03-02 13:00:00")
    index.reconcile(str(root), "2026-03-02 14:00:00")
    assert opened.count() == before == index.chunks().count() - 2
    assert len(folders(index, "chunks")) > len(index.version()["tables"]["chunks"])
    index.tables.retention = 0.0
    t.write(root, 3, t.lines(t.user("last", 30)), append=True)
    touch(paths[3], 60)
    index.reconcile(str(root), "2026-03-02 15:00:00")
    for table, segments in index.version()["tables"].items():
        assert folders(index, table) == sorted(f"pass={s['pass']}" for s in segments)
    assert tables(index) == rebuilt(spark, root, tmp_path, "fresh")
    # A folder of a pass that is still writing has no manifest and stays.
    index.tables.write("chunks", index.tables.read("chunks", "session_id string, bucket int", []).drop("born").unionByName(spark.createDataFrame([("x", 1)], "session_id string, bucket int")), 99, 99, ["bucket"])
    index.tables._clean()
    assert any(f.startswith("pass=000000000099-") for f in folders(index, "chunks"))


def test_a_pass_does_not_write_its_own_segment_twice(spark, tmp_path):
    """Where too much no longer counts, older segments are written without it; what the pass itself has just written is clean."""
    root, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2, most_dead=0.0)
    paths = grown(root)
    index.reconcile(str(root), "2026-03-02 12:00:00")
    t.write(root, 1, t.lines(t.user("again", 9), t.title("ai-title", "T")), append=True)
    touch(paths[1], 60)
    index.reconcile(str(root), "2026-03-02 13:00:00")
    version = index.version()
    for table in ("sessions", "chunks", "postings"):
        assert [int(s["pass"][:12]) for s in version["tables"][table]] == [1, 2]
    assert version["totals"]["dead"] == 0 and version["tables"]["deaths"] == []
    assert tables(index) == rebuilt(spark, root, tmp_path, "fresh")


def test_small_segments_are_merged(spark, tmp_path, monkeypatch):
    merge = sinks.to_merge
    monkeypatch.setattr(sinks, "to_merge", lambda segments: merge(segments, 2))
    root, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2, most_dead=9.0)
    paths = grown(root)
    for k in range(4):
        t.write(root, k % 3 + 1, t.lines(t.user(f"round {k}", 9 + k), t.title("ai-title", f"T{k}")), append=True)
        touch(paths[k % 3 + 1], 60 * (k + 1))
        index.reconcile(str(root), "2026-03-02 13:00:00")
        assert all(len(s) <= 3 for s in index.version()["tables"].values())
    assert tables(index) == rebuilt(spark, root, tmp_path, "fresh")
    assert index.version()["totals"]["dead"] > 0 and index.compact("2026-03-02 14:00:00") and not index.compact("2026-03-02 14:00:00")
    assert index.version()["tables"]["deaths"] == [] and len(index.version()["tables"]["chunks"]) == 1
    assert tables(index) == rebuilt(spark, root, tmp_path, "fresh2")
    assert [merge([{"bytes": b} for b in sizes], 2) for sizes in ([9, 9], [100, 9, 9], [10, 9, 9], [200, 50, 1])] == [[], [{"bytes": 9}] * 2, [{"bytes": 10}, {"bytes": 9}, {"bytes": 9}], [{"bytes": 50}, {"bytes": 1}]]


def test_the_kept_index_is_searched_by_folder(spark, tmp_path):
    from sessionlens.operators import index as I, search as S

    root, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2, token_buckets=16)
    paths = {n: t.write(root, n, t.lines(t.user(f"deposit rejected by bank{n} again", n, root=True), t.assistant("the bank said no", n + 1))) for n in range(1, 6)}
    index.reconcile(str(root), "2026-03-02 12:00:00")
    t.write(root, 1, t.lines(t.user("was the deposit rejected twice", 20), t.title("custom-title", "Deposits")), append=True)
    paths[4].unlink()
    touch(paths[1], 60)
    index.reconcile(str(root), "2026-03-02 13:00:00")
    kept, fresh = index.search_index(), I.build_index(index.chunks())
    queries = spark.createDataFrame([(1, "deposit-rejected"), (2, "bank"), (3, "deposits the"), (4, "nothing of it")], "query_id int, text string")
    found = {}
    for name, ix in (("kept", kept), ("fresh", fresh)):
        rows = S.search(queries, ix, index.sessions(), index.chunks(), F.lit("2026-03-03").cast("timestamp")).drop("recency").collect()
        found[name] = sorted(map(str, rows))
    assert found["kept"] == found["fresh"] != []
    assert kept.size.first() == I.corpus_size(fresh.forward).first()
    assert sorted(map(tuple, kept.vocabulary.collect())) == sorted(map(tuple, fresh.vocabulary.select("token", "df").collect()))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    terms = I.distinct_terms(S.query_terms(queries))
    plan = I.phrase_hits(terms, kept)._jdf.queryExecution().explainString(mode)
    assert "/chunks/" not in plan
    looked = I.lookup(terms.select(F.col("term").alias("token")), kept)._jdf.queryExecution().explainString(mode)
    filters = [line for line in looked.splitlines() if line.startswith("PartitionFilters") and "token_bucket" in line]
    assert filters and all("dynamicpruning" in line for line in filters), looked


def test_streamed_records_can_be_found(spark, tmp_path):
    from sessionlens.operators import search as S

    logs, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2)
    for n in range(1, 4):
        t.write(logs, n, t.lines(*[t.user(f"question {n} {i}", i, root=i == 0) if i % 2 == 0 else t.assistant("answer", i) for i in range(4)], t.title("ai-title", f"T{n}")))
    records = R.read_records(spark, f"{logs}/*/*.jsonl").drop("byte_start", "parse_offset", "file_size", "n_bytes")
    assert index.add_records(records.where("seq <= 2"), "2026-03-02 12:00:00") == 6
    # The same again, and more.
    assert index.add_records(records.where("seq <= 4"), "2026-03-02 12:00:00") == 6
    assert index.add_records(records, "2026-03-02 12:00:00") == 3 and index.add_records(records, "2026-03-02 12:00:00") == 0
    other = SessionIndex(spark, str(tmp_path / "other"), buckets=2)
    other.reconcile(str(logs), "2026-03-02 12:00:00")
    said = lambda ix: sorted(map(str, ix.chunks().select("session_id", "chunk_no", "kind", "text").collect()))
    assert said(index) == said(other) and index.version()["totals"]["chunks"] == other.version()["totals"]["chunks"]
    hits = S.search(spark.createDataFrame([(1, "question 2")], "query_id int, text string"), index.search_index(), index.sessions(), index.chunks(), F.lit("2026-03-03").cast("timestamp"))
    assert t.session_id(2) in {r.session_id for r in hits.collect()}


def test_a_small_pass_writes_little(spark, tmp_path):
    root, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    paths = {n: t.write(root, n, t.lines(*[t.user(" ".join(rng.choices(words, k=300)), i, root=i == 0) for i in range(10)])) for n in range(1, 41)}
    index.reconcile(str(root), "2026-03-02 12:00:00")
    t.write(root, 7, t.lines(t.user("one more line", 50)), append=True)
    touch(paths[7], 60)
    index.reconcile(str(root), "2026-03-02 13:00:00")
    segments = index.version()["tables"]
    first, second = (sum(s[k]["bytes"] for n, s in segments.items() if n != "deaths") for k in (0, 1))
    assert second < first / 20
