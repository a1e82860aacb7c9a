"""Streams end in the same tables as batches."""

import random
import shutil

import pandas as pd
import pytest
import transcripts as t
from pyspark.sql import functions as F

from sessionlens.operators import sessions as S
from sessionlens.plans import queries
from sessionlens.plans.reconcile import SessionIndex
from sessionlens.sources import transcripts as R
from sessionlens.streaming import changes, follow, stateful


def walk(instants, settle, longest):
    out, first, last, n = [], None, None, 0
    for at in sorted(set(instants)):
        if first is not None and (at - last > settle or at - first > longest):
            out.append((first, last, n))
            first, n = None, 0
        first, last, n = (at if first is None else first), at, n + 1
    return out + [(first, last, n)]


def passed(instants, interval):
    out = []
    for at in sorted(set(instants)):
        if not out or at - out[-1] >= interval:
            out.append(at)
    return out


@pytest.fixture(scope="module")
def events():
    rng, rows = random.Random(3), {}
    for key, gap in (("steady", 1), ("bursty", 3), ("sparse", 30), ("hot", 0.5)):
        at, rows[key] = 1_700_000_000_000, []
        for _ in range(400):
            at += int(rng.choice([gap * 1000, gap * 2000, gap * 500, 2000 if key == "bursty" else gap * 1000]))
            rows[key].append(at)
    rows["one"] = [1_700_000_000_000]
    rows["edge"] = [1_700_000_000_000 + d for d in (0, 2000, 4000, 6001, 8002, 26001, 26002)]
    return rows


def frame(spark, events):
    flat = [(k, at) for k, v in events.items() for at in v]
    random.Random(5).shuffle(flat)
    return spark.createDataFrame(flat, "key string, ms bigint").select("key", F.timestamp_millis("ms").alias("ts"))


def ms(value):
    return int(pd.Timestamp(value).value // 1_000_000)


def test_debounce_matches_a_walk(spark, events):
    got = {}
    for r in changes.debounce(frame(spark, events), 2, 20).collect():
        got.setdefault(r.key, []).append((ms(r.first_seen), ms(r.last_seen), r.changes))
    assert {k: sorted(v) for k, v in got.items()} == {k: walk(v, 2000, 20000) for k, v in events.items()}


def test_throttle_matches_a_walk(spark, events):
    got = {}
    for r in changes.throttle(frame(spark, events), 5).collect():
        got.setdefault(r.key, []).append(ms(r.ts))
    assert {k: sorted(v) for k, v in got.items()} == {k: passed(v, 5000) for k, v in events.items()}


def test_one_endless_burst_needs_no_python_and_no_task_of_its_own(spark):
    rng, at, instants = random.Random(8), 1_700_000_000_000, []
    for _ in range(6000):
        at += rng.randint(1, 1900)
        instants.append(at)
    rows = frame(spark, {"hot": instants, "cold": instants[:3]})
    got = changes.debounce(rows, 2, 20)
    assert sorted((ms(r.first_seen), ms(r.last_seen), r.changes) for r in got.where("key = 'hot'").collect()) == walk(instants, 2000, 20000)
    assert sorted(ms(r.ts) for r in changes.throttle(rows, 5).where("key = 'hot'").collect()) == passed(instants, 5000)
    cut = changes.bursts(rows, 2_000_000)
    assert cut.select("key", "burst").distinct().count() == 2
    plan = changes.successors(cut, 20_000_001, 2_000_000)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "hashpartitioning(key" in plan and "cell" in plan


def test_debounce_keeps_long_bursts_apart(spark):
    """The last hand-over of one long burst and the first of the next lie in one stretch of the maximum wait."""
    start = 1_700_000_000_000 - 1_700_000_000_000 % 20_000
    first = [start + at for at in range(0, 42_001, 1500)]
    second = [first[-1] + 2500 + at for at in range(0, 42_001, 1500)]
    got = changes.debounce(frame(spark, {"k": first + second}), 2, 20).collect()
    assert sorted((ms(r.first_seen), ms(r.last_seen), r.changes) for r in got) == walk(first + second, 2000, 20000)


@pytest.mark.parametrize("name", ["follow_segments", "running_sessions"])
def test_a_table_may_be_a_folder_of_files(spark, tmp_path, name):
    """A table of several part files is followed like one of a single file."""
    table = "/root/testdata/sf0.001/conversations.parquet"
    spark.read.parquet(table).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = sorted(map(str, queries.REGISTRY[name](spark, "/root/testdata/sf0.001").collect()))
    assert sorted(map(str, queries.REGISTRY[name](spark, str(tmp_path)).collect())) == want and want


def test_bursts_do_not_depend_on_cells(spark, events):
    rows = frame(spark, events)
    small = {tuple(r) for r in changes.bursts(rows, 2_000_000, 3_000_000).collect()}
    assert small == {tuple(r) for r in changes.bursts(rows, 2_000_000, 10**15).collect()}


def test_state_operators(spark, events, tmp_path):
    """The keyed-state forms over an ordered file stream agree with the walks."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    flat = sorted((at, k) for k, v in events.items() for at in v)
    for i in range(3):
        part = flat[i * len(flat) // 3:(i + 1) * len(flat) // 3]
        spark.createDataFrame([(k, at) for at, k in part], "key string, ms bigint").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        (tmp_path / "flat").mkdir(exist_ok=True)
        next((tmp_path / "in" / str(i)).glob("*.parquet")).rename(tmp_path / "flat" / f"{i}.parquet")

    def stream():
        rows = spark.readStream.schema("key string, ms bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")
        return rows.select("key", F.timestamp_millis("ms").alias("ts"))

    def run(df, name):
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/{name}").collect()

    got = {}
    for r in run(stateful.throttle_stream(stream(), 5), "throttle"):
        got.setdefault(r.key, []).append(ms(r.ts))
    assert {k: sorted(v) for k, v in got.items()} == {k: passed(v, 5000) for k, v in events.items()}

    rows = run(stateful.debounce_stream(stream().withWatermark("ts", "0 seconds"), 2, 20), "debounce")
    want = {(k, f, l, n) for k, v in events.items() for f, l, n in walk(v, 2000, 20000)}
    have = {(r.key, ms(r.first_seen), ms(r.last_seen), r.changes) for r in rows}
    end = max(at for at, _ in flat)
    assert have <= want
    assert {w for w in want - have} == {w for w in want if min(w[2] + 2000, w[1] + 20000) >= end}


def test_segments_are_merged_once(spark, tmp_path):
    """Batches of appended records give the session table of one pass, also when a batch is replayed."""
    logs = tmp_path / "logs"
    for n in range(1, 5):
        t.write(logs, n, t.lines(*[t.user(f"p{n} {i}", i, root=i == 0) if i % 2 == 0 else t.assistant("a", i) for i in range(6)], t.title("ai-title", f"T{n}")))
    records = R.read_records(spark, f"{logs}/*/*.jsonl").drop("byte_start", "parse_offset", "file_size", "n_bytes")
    whole = S.session_state(records, ("session_id",))
    for i in range(4):
        part = records.where((F.col("seq") > i * 2) & (F.col("seq") <= i * 2 + 2)).coalesce(1)
        part.write.parquet(f"{tmp_path}/in/{i}")
        (tmp_path / "segments").mkdir(exist_ok=True)
        next((tmp_path / "in" / str(i)).glob("*.parquet")).rename(tmp_path / "segments" / f"{i}.parquet")

    def stream(folder="segments"):
        return spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{folder}")

    states = f"{tmp_path}/states"
    # Two segments first; what follows comes under another checkpoint, whose batches are numbered from 0 again.
    (tmp_path / "some").mkdir()
    for i in range(2):
        shutil.copy(tmp_path / "segments" / f"{i}.parquet", tmp_path / "some")
    follow.follow_segments(stream("some"), states, f"{tmp_path}/c0", 4).awaitTermination()
    follow.follow_segments(stream(), states, f"{tmp_path}/c1", 4).awaitTermination()
    columns = ["session_id", *S.STATE_COLUMNS]
    want = sorted(map(str, whole.select(columns).collect()))
    assert sorted(map(str, spark.read.parquet(states).select(columns).collect())) == want
    # A new checkpoint replays the same batches into the same table.
    follow.follow_segments(stream(), states, f"{tmp_path}/c2", 4).awaitTermination()
    assert sorted(map(str, spark.read.parquet(states).select(columns).collect())) == want

    follow.write_updates(follow.running_sessions(stream()), f"{tmp_path}/updates", f"{tmp_path}/c3").awaitTermination()
    assert sorted(map(str, follow.latest_updates(spark, f"{tmp_path}/updates").select(columns).collect())) == want


def test_following_a_folder(spark, tmp_path):
    logs = tmp_path / "logs"
    t.write(logs, 1, t.lines(t.user("hello", 0, root=True)))
    index = SessionIndex(spark, str(tmp_path / "index"), buckets=2)
    follow.follow_folder(index, str(logs), lambda: "2026-03-03 00:00:00", every_seconds=0, passes=1)
    t.write(logs, 1, t.lines(t.user("again", 1)), append=True)
    t.write(logs, 2, t.lines(t.user("other", 0, root=True)))
    follow.follow_folder(index, str(logs), lambda: "2026-03-03 00:00:00", every_seconds=0, passes=1)
    assert {r.session_id: r.message_count for r in index.sessions().collect()} == {t.session_id(1): 2, t.session_id(2): 1}


def test_changed_files_wait_until_they_are_quiet(spark, tmp_path):
    logs, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2)
    clock = iter([0, 1, 4, 5, 8])
    look = lambda: follow.follow_folder(index, str(logs), lambda: "2026-03-03 00:00:00", 0, 1, 2.0, 20.0, clock.__next__)
    t.write(logs, 1, t.lines(t.user("hello", 0, root=True)))
    waiting = follow.pending_changes(index.plan(str(logs)), None, 0.0)
    again = follow.pending_changes(index.plan(str(logs)), waiting, 3.0).first()
    assert (again.first_seen, again.last_seen) == (0.0, 0.0)
    t.write(logs, 1, t.lines(t.user("more", 1)), append=True)
    grown = follow.pending_changes(index.plan(str(logs)), waiting, 5.0).first()
    assert (grown.first_seen, grown.last_seen) == (0.0, 5.0)
    follow.follow_folder(index, str(logs), lambda: "2026-03-03 00:00:00", 0, 2, 2.0, 20.0, clock.__next__)
    assert index.version()["number"] == 0
    look()
    assert index.version()["number"] == 0
    # Looks that follow each other in one call remember what they saw.
    times = iter([10, 13])
    follow.follow_folder(index, str(logs), lambda: "2026-03-03 00:00:00", 0, 2, 2.0, 20.0, times.__next__)
    assert {r.session_id: r.message_count for r in index.sessions().collect()} == {t.session_id(1): 2}
    # A file that is not ready is left out of the pass of one that is.
    t.write(logs, 2, t.lines(t.user("other", 0, root=True)))
    t.write(logs, 3, t.lines(t.user("third", 0, root=True)))
    only = spark.createDataFrame([(t.session_id(3),)], "session_id string")
    assert index.reconcile(str(logs), "2026-03-03 00:00:00", only=only).first().indexed == 1
    assert {r.session_id for r in index.sessions().collect()} == {t.session_id(1), t.session_id(3)}


def test_streamed_segments_can_be_searched(spark, tmp_path):
    from sessionlens.operators import search as SR

    logs, index = tmp_path / "logs", SessionIndex(spark, str(tmp_path / "index"), buckets=2)
    t.write(logs, 1, t.lines(*[t.user(f"question {i}", i, root=i == 0) for i in range(4)], t.title("ai-title", "Streamed")))
    records = R.read_records(spark, f"{logs}/*/*.jsonl").drop("byte_start", "parse_offset", "file_size", "n_bytes")
    (tmp_path / "segments").mkdir()
    for i in range(2):
        records.where((F.col("seq") > 2 * i) & (F.col("seq") <= 2 * i + 3)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        next((tmp_path / "in" / str(i)).glob("*.parquet")).rename(tmp_path / "segments" / f"{i}.parquet")
    stream = lambda: spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/segments")
    for checkpoint in ("a", "b"):
        follow.follow_index(stream(), index, lambda: "2026-03-03 00:00:00", f"{tmp_path}/{checkpoint}").awaitTermination()
        queries = spark.createDataFrame([(1, "question streamed")], "query_id int, text string")
        found = SR.search(queries, index.search_index(), index.sessions(), index.chunks(), F.lit("2026-03-03").cast("timestamp")).collect()
        assert [r.session_id for r in found] == [t.session_id(1)]
        assert index.chunks().where("kind = 4").count() == 4 and index.sessions().first().message_count == 4
