"""Headline queries on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from sessionlens.operators import search as S  # noqa: E402
from sessionlens.plans import queries as Q  # noqa: E402
from sessionlens.plans.queries import REGISTRY  # noqa: E402
from sessionlens.plans.reconcile import SessionIndex  # noqa: E402
from sessionlens.session import get_spark  # noqa: E402
from sessionlens.sources import tables as A  # noqa: E402

QUERIES = (
    "recent_sessions", "sessions", "chunks_all", "chunks_split", "index_stats", "tokens", "postings",
    "messages_merged", "active_days", "session_recap", "project_recap", "week_rollup", "recap_text", "week_text",
    "change_plan", "upsert", "tail_merge", "reconcile_tally", "debounce", "throttle",
)


def write_transcripts(spark, sf_dir: str, root: Path) -> list[Path]:
    """Conversations as one transcript file each, in ten project folders. Input of the reindex timings."""
    content = F.get("blocks", F.lit(0))
    line = F.to_json(F.struct(
        "type", "cwd", F.col("git_branch").alias("gitBranch"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.when(F.col("type") == "ai-title", F.col("title_text")).alias("aiTitle"),
        F.when(F.col("has_message"), F.struct(content.alias("content"))).alias("message")))
    rows = A.conversation_records(spark, sf_dir).select("session_id", "seq", line.alias("line"))
    files = rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]), "\n").alias("text"))
    paths = []
    for row in files.toLocalIterator():
        n = int(row.session_id)
        path = root / f"project{n % 10}" / f"{n:08x}-1111-4222-8333-444455556666.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(row.text + "\n")
        paths.append(path)
    return paths


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("OFF")
    only = sys.argv[1:]
    times: dict[str, float] = {}

    def timed(name: str, fn) -> None:
        start = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    def run(name: str) -> None:
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("recent_sessions")
    run("tokens")
    for name in QUERIES:
        if not only or name in only:
            timed(name, lambda: run(name))
    if not only or "search" in only:
        # All benchmark queries (200 at sf0.1) at once, against an index that is already there.
        built: list = []
        timed("index_build", lambda: built.append(Q.document_index(spark, sf_dir)))
        timed("search_batch", lambda: S.search(
            A.benchmark_queries(spark, sf_dir), built[0], A.document_sessions(spark, sf_dir), Q.document_chunks(spark, sf_dir), Q.now(),
        ).write.format("noop").mode("overwrite").save())
    if not only or "reindex" in only:
        folder = Path(tempfile.mkdtemp(prefix="spark-"))
        paths = write_transcripts(spark, sf_dir, folder / "logs")
        index = SessionIndex(spark, str(folder / "index"), buckets=16)
        timed("reindex_full", lambda: index.reconcile(str(folder / "logs"), "2024-02-01 00:00:00").collect())
        for path in sorted(paths)[:: 100]:
            with open(path, "a") as f:
                f.write('{"type":"user","message":{"content":"one more question"},"timestamp":"2024-01-31T10:00:00Z","cwd":"/work/p1"}\n')
        timed("reindex_1pct", lambda: index.reconcile(str(folder / "logs"), "2024-02-02 00:00:00").collect())
        timed("reindex_nothing", lambda: index.reconcile(str(folder / "logs"), "2024-02-03 00:00:00").collect())
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
