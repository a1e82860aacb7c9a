"""Hazards of transcript files, one per file."""

import hashlib
import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

import transcripts as t
from sessionlens.operators import chunks as C, sessions as S
from sessionlens.sources import transcripts as R


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    w = lambda n, *a, **k: t.write(root, n, *a, **k)
    w(1, t.lines(t.user("plain string", 0, root=True), t.user([{"type": "text", "text": "in blocks"}, {"type": "image"}, {"type": "text", "text": " "}], 1), t.assistant("reply", 2)))
    w(2, t.lines(t.user("real prompt", 0, root=True), t.user([{"type": "tool_result", "content": "tool text"}], 1, toolUseResult={"x": 1}),
                 t.user("meta", 2, isMeta=True), t.user("not meta", 3, isMeta="true"), t.user("null result", 4, toolUseResult=None), {"type": "user", "timestamp": t.stamp(5)}))
    ignored = [{"type": k, "timestamp": t.stamp(30 + i), "cwd": "/decoy", "message": {"content": "no"}} for i, k in enumerate(("attachment", "system", "mode", "pr-link"))]
    w(3, t.lines(*ignored[:2], t.user("hello", 10, root=True), *ignored[2:], {"type": "brand-new", "cwd": "/new", "timestamp": t.stamp(50)}))
    w(4, t.lines(t.user("first words", 0, root=True), t.title("custom-title", "Old"), t.title("ai-title", "Made up"), t.title("custom-title", "  New\n title "), t.title("last-prompt", "resume me")))
    w(5, t.lines(t.assistant("early", 0, cwd="/early", branch="b0"), t.user("x", 1, root=True, cwd="C:\\Work\\App\\", branch="rel/9"), t.user("y", 2, root=True, cwd="/other")))
    w(6, t.lines(t.user("whole", 0, root=True)) + json.dumps(t.user("cut", 1))[:-5])
    w(7, b"\xef\xbb\xbf" + t.lines(t.user("bom", 0, root=True), end="\r\n").encode() + t.lines("", t.user("lf", 1)).encode())
    w(8, t.lines("not json", "[1,2]", "", t.user("after", 0, root=True), '{"type":"user","message":{"content":"broken"}'))
    w(9, t.lines(t.user("big", 0, root=True, toolUseResult="x" * 700_000), t.user("y" * 70_000, 1), t.user("z", 2)))
    w(10, "")
    t.write(root, 11, t.lines(t.user("deep", 0)), project="proj/sub")
    (root / "proj" / "notes.jsonl").write_text("{}\n")
    records = R.read_records(spark, f"{root}/*/*.jsonl")
    sessions = S.build_sessions(records)
    rows = {r.session_id: r for r in sessions.collect()}
    chunks = {}
    for r in C.all_chunks(records, sessions).orderBy("session_id", "chunk_no").collect():
        chunks.setdefault(r.session_id, []).append((r.kind, r.text))
    return root, rows, chunks


def of(parsed, n):
    _, rows, chunks = parsed
    return rows[t.session_id(n)], chunks[t.session_id(n)]


def said(chunks):
    return [c for c in chunks if c[0] >= 4]


def test_string_and_block_content(parsed):
    row, chunks = of(parsed, 1)
    assert said(chunks) == [(4, "plain string"), (4, "in blocks"), (5, "reply")]
    assert row.message_count == 3 and row.title == "plain string" and row.title_source == 3


def test_tool_results_and_meta_are_no_prompts(parsed):
    row, chunks = of(parsed, 2)
    assert said(chunks) == [(4, "real prompt"), (4, "not meta")]
    assert row.message_count == 2


def test_ignored_types_move_only_the_bounds(parsed):
    row, chunks = of(parsed, 3)
    assert row.folder_display == "/work/app"
    assert row.first_activity.minute == 10 and row.last_activity.minute == 50
    assert said(chunks) == [(4, "hello")]


def test_last_title_wins(parsed):
    row, chunks = of(parsed, 4)
    assert (row.title, row.title_source) == ("New title", 1)
    assert row.last_prompt == "resume me"
    assert [c for c in chunks if c[0] < 4] == [(1, "New title"), (2, "/work/app main"), (3, "resume me")]


def test_opening_record_decides_folder_and_branch(parsed):
    row, _ = of(parsed, 5)
    assert (row.folder_display, row.folder_key, row.git_branch) == ("C:\\Work\\App", "C:\\WORK\\APP", "rel/9")


def test_unfinished_line_waits(parsed):
    row, chunks = of(parsed, 6)
    assert said(chunks) == [(4, "whole")] and row.parse_error is None


def test_mark_and_line_ends(parsed):
    row, chunks = of(parsed, 7)
    assert said(chunks) == [(4, "bom"), (4, "lf")] and row.parse_error is None


def test_malformed_lines_are_counted(parsed):
    row, chunks = of(parsed, 8)
    assert row.parse_error == "3 line(s) skipped: not well-formed JSON." and said(chunks) == [(4, "after")]


def test_huge_lines(parsed):
    _, chunks = of(parsed, 9)
    assert "".join(text for _, text in said(chunks)) == "y" * 70_000 + "z"
    assert max(len(text) for _, text in chunks) <= 8192


def test_offsets_and_line_numbers(spark, tmp_path):
    body = t.lines(*[t.user(f"line {i}", i) for i in range(2000)])
    plain = t.write(tmp_path, 1, body + '{"half":')
    marked = t.write(tmp_path, 2, b"\xef\xbb\xbf" + body.encode())
    # Small splits: the file is read by several tasks, and its lines still get their true places.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        parsed = R.parse_lines(R.read_lines(spark, [str(plain), str(marked)]))
        assert parsed.select("file_path", "block_start").distinct().count() > 4
        rows = R.number_lines(parsed).select("file_path", "seq", "byte_start", F.col("blocks")[0].alias("text"), "parse_offset").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    starts, at = [], 0
    for line in body.encode().split(b"\n")[:-1]:
        starts.append(at)
        at += len(line) + 1
    for path, mark in ((plain, 0), (marked, 3)):
        mine = sorted((r for r in rows if r.file_path.endswith(path.name)), key=lambda r: r.seq)
        assert [r.text for r in mine] == [f"line {i}" for i in range(2000)]
        assert [r.seq for r in mine] == list(range(1, 2001))
        assert [r.byte_start for r in mine] == [0] + [s + mark for s in starts[1:]]
        assert {r.parse_offset for r in mine} == {at + mark}


def test_listing_and_heads(spark, parsed):
    root, _, _ = parsed
    files = R.list_files(spark, str(root))
    listed = R.newest_first(files).collect()
    assert {r.session_id for r in listed} == {t.session_id(n) for n in range(1, 11)}
    assert [r.mtime for r in listed] == sorted((r.mtime for r in listed), reverse=True)
    heads = {r.file_path: r for r in R.head_hashes(files).collect()}
    for r in listed:
        data = (root / "proj" / f"{r.session_id}.jsonl").read_bytes()
        want = hashlib.sha256(data[:4096]).hexdigest().upper() if data else None
        assert heads[r.file_path].head_sha256 == want and heads[r.file_path].readable


def test_describe_paths(spark, parsed):
    root, _, _ = parsed
    good = f"{root}/proj/{t.session_id(1)}.jsonl"
    asked = [good, f"{root}/proj/sub/{t.session_id(11)}.jsonl", f"{root}/proj/notes.jsonl", f"{root}/proj/{t.session_id(99)}.jsonl", "/elsewhere/x.jsonl"]
    rows = R.describe_paths(spark.createDataFrame([(p,) for p in asked], "path string"), R.list_files(spark, str(root)), str(root)).collect()
    assert len(rows) == 5 and [r.path for r in rows if r.session_id] == [good]


def test_session_ids(spark):
    cases = {"C:\\x\\0A1B2C3D-4e5f-4a6b-8c7d-9e0f1a2b3c4d.jsonl": "0a1b2c3d-4e5f-4a6b-8c7d-9e0f1a2b3c4d",
             "0a1b2c3d-4e5f-4a6b-8c7d-9e0f1a2b3c4d": "0a1b2c3d-4e5f-4a6b-8c7d-9e0f1a2b3c4d", "agent-1.jsonl": None, "/a/": None,
             "0a1b2c3d4e5f4a6b8c7d9e0f1a2b3c4d.jsonl": None, "{0a1b2c3d-4e5f-4a6b-8c7d-9e0f1a2b3c4d}.jsonl": None, "0a1b2c3d-4e5f-4a6b-8c7d-9e0f1a2b3c4d.a.b": None}
    rows = spark.createDataFrame(list(cases.items()), "path string, want string").withColumn("got", R.session_id_of(F.col("path"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_long_paths_are_taken_apart_in_one_go(spark):
    """A pattern that is anchored at the end only takes a path's length squared, for every line of its file."""
    session = "0a1b2c3d-4e5f-4a6b-8c7d-9e0f1a2b3c4d"
    cases = {f"/{'a' * 400_000}/{session}.jsonl": (session, session), f"C:\\{'b' * 400_000}\\x.y.jsonl": (None, "x.y"), "a/b\\c.d/.jsonl": (None, ""), "x/": (None, ""), f"{session}.a\n": (session, session)}
    rows = spark.createDataFrame([(k,) for k in cases], "path string")
    start = time.monotonic()
    got = rows.select("path", R.session_id_of(F.col("path")), R.file_name_of(F.col("path"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == cases and time.monotonic() - start < 20


def test_files_are_opened_by_many_tasks(spark, tmp_path):
    """A few bytes name a file, so by their bytes all files would be opened by one task."""
    lines = spark.range(40).select(F.format_string("%08d-1111-4222-8333-444455556666", "id").alias("session_id"), F.lit("work").alias("folder"), F.lit(1).alias("seq"), F.lit("{}").alias("line"))
    R.write_transcripts(lines, f"{tmp_path}/logs")
    files = R.list_files(spark, f"{tmp_path}/logs").coalesce(1)
    for rows in (R.head_hashes(files), R.read_tails(files.withColumn("offset", F.lit(0).cast("bigint")))):
        assert rows.count() == 40 and rows.select(F.spark_partition_id()).distinct().count() > 4


def ranges_of(paths):
    return pd.DataFrame([(str(p), p.stat().st_size, 0, 0) for p in paths], columns=["file_path", "size", "offset", "block_start"])


def test_small_files_share_a_frame(tmp_path):
    """A frame for each file cost several times its reading. Files that cannot be read take no line of their neighbours along."""
    paths = [t.write(tmp_path, n, t.lines(t.user(f"a {n}", 0, root=True), t.assistant("b", 1))) for n in range(300)]
    work = ranges_of(paths)
    work.loc[7, "size"] += 1
    paths[9].unlink()
    frames = list(R.range_frames(iter([work.iloc[:200], work.iloc[200:]])))
    assert len(frames) == 1
    got = frames[0]
    assert got[got["problem"].notna()][["file_path", "problem"]].values.tolist() == [[str(paths[7]), "failed"], [str(paths[9]), "missing"]]
    lines = got[got["problem"].isna()]
    assert lines["file_path"].tolist() == [str(p) for n, p in enumerate(paths) if n not in (7, 9) for _ in range(2)]
    assert lines["line_order"].tolist() == [0, 1] * 298 and [json.loads(x)["type"] for x in lines["line"][:2]] == ["user", "assistant"]


def test_empty_lines_fill_a_frame_too(tmp_path):
    """They were not counted, so a file of nothing else was held whole."""
    frames = list(R.range_frames(iter([ranges_of([t.write(tmp_path, 1, "\n" * 10_000)])]), piece=100_000))
    assert len(frames) > 10 and sum(map(len, frames)) == 10_000


def test_a_file_that_fails_later_leaves_its_neighbours(tmp_path, monkeypatch):
    """An error behind the first frame of a file is told once, and the lines that other files have in that frame still count."""
    paths = [t.write(tmp_path, n, t.lines(*[t.user(f"{n} {i}", 0) for i in range(20)])) for n in range(3)]
    read = R.lines_from

    def breaks(stream, *args):
        for i, found in enumerate(read(stream, *args)):
            if i == 15 and b'"content": "1 ' in found[1]:
                raise OSError("gone bad")
            yield found

    monkeypatch.setattr(R, "lines_from", breaks)
    for piece in (1_000, 5_000, 1 << 20):
        got = pd.concat(R.range_frames(iter([ranges_of(paths)]), piece=piece))
        bad = got[got["problem"].notna()]
        assert bad[["file_path", "problem"]].values.tolist() == [[str(paths[1]), "failed"]]
        assert got[got["problem"].isna() & (got["file_path"] != str(paths[1]))]["line_order"].tolist() == [*range(20)] * 2
