"""Keeping the tables current with a folder of transcripts.

One pass: list files, compare with what is stored, read only what changed, merge, append what is new to every table, note what no longer
counts, and make all of it current by one manifest. Of a resumed file only the bytes behind its stored offset are read. Nothing that is
stored is rewritten but small segments, which are merged as they pile up, and tables of which too large a share no longer counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlens import constants as K
from sessionlens.functions import text as X
from sessionlens.operators import chunks as C, index as I, merge as M, recap, sessions as S
from sessionlens.session import delete, stage, staging
from sessionlens.sources import sinks, transcripts as R

_PLACE = "struct<seq:bigint,cwd:string,branch:string>"
_TEXT = "struct<seq:bigint,text:string>"
_STATE = (
    f"root:{_PLACE},seen:{_PLACE},custom_title:{_TEXT},ai_title:{_TEXT},last_prompt:{_TEXT},first_prompt:{_TEXT},"
    "first_activity:timestamp,last_activity:timestamp,message_count:bigint,malformed_count:bigint,last_seq:bigint"
)
SESSION_SCHEMA = (
    "session_id string, owner string, file_path string, file_name string, title string, title_source int, custom_title string, "
    "ai_title string, first_prompt string, folder_display string, folder_key string, folder_source int, git_branch string, "
    "last_prompt string, first_activity timestamp, last_activity timestamp, message_count bigint, file_size bigint, "
    "mtime timestamp, head_sha256 string, parse_offset bigint, line_count bigint, parse_error string, indexed_at timestamp, "
    f"state struct<{_STATE}>, bucket int"
)
TALLY_SCHEMA = "discovered bigint, indexed bigint, skipped bigint, failed bigint, pruned bigint, chunks_written bigint, bytes_read bigint, parse_errors bigint"
CHUNK_SCHEMA = "session_id string, owner string, chunk_no bigint, kind int, ts timestamp, text string, derived int, bucket int"
POSTINGS_SCHEMA = "token string, session_id string, chunk_no bigint, kind int, n_tokens int, tf int, positions array<int>, token_bucket int"
VOCABULARY_SCHEMA = "token string, df bigint, letter_bucket int"
DEATH_SCHEMA = "session_id string, kind int, died bigint"
#: Folders of every table, outermost first.
LAYOUT = {"sessions": ["bucket"], "chunks": ["derived", "bucket"], "postings": ["token_bucket"], "vocabulary": ["letter_bucket"], "deaths": []}
#: How the rows of a file are ordered, where it matters to those who read it.
ORDER = {"chunks": ["ts"]}
SCHEMAS = {"sessions": SESSION_SCHEMA, "chunks": CHUNK_SCHEMA, "postings": POSTINGS_SCHEMA, "vocabulary": VOCABULARY_SCHEMA, "deaths": DEATH_SCHEMA}
#: What a death means that is of no chunk kind: the session's row; all its chunks.
SESSION_ROW, ALL_CHUNKS = -1, -2
LETTER_BUCKETS = 16
#: Share of chunks that no longer count beyond which a pass leaves them out for good.
MOST_DEAD = 0.25


class SessionIndex:
    """The tables of one index folder. A pass changes all of them at once or, if it fails anywhere, none."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = sinks.DEFAULT_BUCKETS, token_buckets: int | None = None, retention: float = 3600.0, most_dead: float = MOST_DEAD):
        self.spark, self.path, self.buckets, self.token_buckets, self.most_dead = spark, path.rstrip("/"), buckets, token_buckets or buckets, most_dead
        self.tables = sinks.Versions(spark, self.path, retention)

    def version(self) -> dict:
        """What is current now. Reads that are given the same version see the same tables."""
        return self.tables.current()

    def _read(self, table: str, version: dict) -> DataFrame:
        return self.tables.read(table, SCHEMAS[table], version["tables"].get(table, []))

    def _deaths(self, version: dict) -> DataFrame | None:
        """Newest death per session and kind, or None where there are none."""
        if not version["tables"].get("deaths"):
            return None
        return self._read("deaths", version).groupBy("session_id", "kind").agg(F.max("died").alias("died"))

    def _alive(self, rows: DataFrame, deaths: DataFrame | None) -> DataFrame:
        """Rows (of sessions, or chunks with a kind) that no later pass has replaced."""
        if deaths is None:
            return rows
        d = deaths.select(F.col("session_id").alias("_dead"), F.col("kind").alias("_kind"), "died")
        meant = d["_kind"] == SESSION_ROW
        if "kind" in rows.columns:
            meant = (d["_kind"] == ALL_CHUNKS) | (d["_kind"] == rows["kind"])
        return rows.join(d, (rows["session_id"] == d["_dead"]) & meant & (rows["born"] < d["died"]), "left_anti")

    def sessions(self, version: dict | None = None) -> DataFrame:
        version = version or self.version()
        return self._alive(self._read("sessions", version), self._deaths(version)).drop("born")

    def chunks(self, version: dict | None = None) -> DataFrame:
        version = version or self.version()
        return self._alive(self._read("chunks", version), self._deaths(version)).drop("born", "derived")

    def meta(self) -> DataFrame:
        done = self.version()["completed_at"]
        return self.spark.createDataFrame([(done,)] if done else [], "completed_at string").select(F.col("completed_at").cast("timestamp"))

    def search_index(self, version: dict | None = None) -> I.Index:
        """The kept index: postings in folders by token, the vocabulary as the sum of the passes' changes, the corpus size as noted."""
        version = version or self.version()
        deaths = self._deaths(version)
        totals = version["totals"]
        n, tokens = totals.get("chunks", 0), totals.get("tokens", 0)
        size = self.spark.range(1).select(F.lit(n).cast("bigint").alias("n_chunks"), (F.lit(tokens / n) if n else F.lit(None)).cast("double").alias("mean_length"))
        vocabulary = self._vocabulary(self._read("vocabulary", version)).select("token", "df")
        return I.Index(I.forward_index(self.chunks(version)), self._read("postings", version), vocabulary, size, self.token_buckets, lambda found: self._alive(found, deaths))

    def recaps(self, requests: DataFrame, repos: DataFrame, calendar: recap.Calendar, version: dict | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Focus days, frames and session recaps for requests (owner, today, requested). Chunks are ordered by time in their files, and
        replies are read for the focus days only."""
        version = version or self.version()
        said = self._alive(self._read("chunks", version).where("derived = 0"), self._deaths(version)).drop("born", "derived")
        focus, frames, told = recap.focused(said, requests, calendar, **options)
        return focus, frames, recap.recaps_of(told, recap.session_projects(self.sessions(version), repos))

    @staticmethod
    def _vocabulary(changes: DataFrame) -> DataFrame:
        return changes.groupBy("letter_bucket", "token").agg(F.sum("df").alias("df")).where("df != 0")

    # ------------------------------------------------------------ one pass

    def plan(self, root: str, forced: bool = False, version: dict | None = None) -> DataFrame:
        """Change plan of every known or present file. Hashes are read only where they can matter."""
        known = self.sessions(version)
        stored = known.select("session_id", F.col("file_size").alias("size"), "mtime", "head_sha256", "parse_offset")
        lines = known.select("session_id", F.col("line_count").alias("stored_lines"))
        listed = R.list_files(self.spark, root)
        listed = listed.groupBy("session_id").agg(F.max(F.struct("mtime", "file_path", "file_name", "size")).alias("f")).select(
            "session_id", "f.file_path", "f.file_name", "f.size", "f.mtime")
        first = stage(M.change_plan(stored, listed.withColumn("head_sha256", F.lit(None).cast("string")), forced), "plan")
        heads = R.head_hashes(first.where(F.col("plan").isin("full", "resume")))
        seen = first.drop("head_sha256").join(heads, "file_path", "left").join(lines, "session_id", "left")
        rewritten = (F.col("plan") == "resume") & F.coalesce(F.upper("stored_head") != F.col("stored_part_sha256"), F.lit(False))
        return seen.withColumns({
            "reason": F.when(rewritten, F.lit("head_changed")).otherwise(F.col("reason")),
            "offset": F.when(rewritten, F.lit(0)).otherwise(F.col("offset")),
            "plan": F.when(rewritten, F.lit("full")).otherwise(F.col("plan")),
        })

    def reconcile(self, root: str, now, forced: bool = False, owner=None, attempts: int = 5, only: DataFrame | None = None) -> DataFrame:
        """Bring the tables in line with ``root``; returns the tally row.

        ``now`` is the completion time to record, ``owner`` an optional column over ``file_path``. A file that cannot be read, or
        that goes while the pass runs, stays as it is stored and is tried again by the next pass. If another pass comes first, this
        one starts anew from what that one has left, at most ``attempts`` times. ``only`` names the sessions (session_id) to look at;
        whatever else has changed waits for a later pass.
        """
        return M.reconcile_tally(self.outcomes(root, now, forced, owner, attempts, only))

    def outcomes(self, root: str, now, forced: bool = False, owner=None, attempts: int = 5, only: DataFrame | None = None) -> DataFrame:
        """A pass as :meth:`reconcile` makes it; returns what became of every file instead of the counts."""
        return self._retried(lambda base: stage(self._pass(root, now, forced, owner, base, only), "outcomes", outer=True), attempts)

    def _retried(self, work, attempts: int):
        for attempt in range(attempts):
            try:
                with staging(self.spark):
                    return work(self.version())
            except sinks.Conflict:
                if attempt + 1 == attempts:
                    raise

    def _pass(self, root: str, now, forced: bool, owner, base: dict, only: DataFrame | None) -> DataFrame:
        plan = self.plan(root, forced, base)
        if only is not None:
            plan = plan.join(only.select("session_id", F.lit(True).alias("_asked")).distinct(), "session_id", "left")
            # A file that is new and not asked for is as if it were not there.
            plan = plan.where(F.col("_asked") | (F.coalesce("reason", F.lit("")) != "never_indexed"))
            plan = plan.withColumns({"plan": F.when(F.col("_asked"), F.col("plan")).otherwise(F.lit("skip")), "reason": F.when(F.col("_asked"), F.col("reason"))}).drop("_asked")
        plan = stage(plan, "plan")
        todo = plan.where(F.col("plan").isin("full", "resume") & F.coalesce("readable", F.lit(True)))
        todo = stage(todo.withColumn("line_count", F.when(F.col("plan") == "resume", F.coalesce("stored_lines", F.lit(0))).otherwise(F.lit(0))), "todo")
        if plan.where(F.col("plan") == "prune").isEmpty() and todo.isEmpty():
            self.tables.commit(base, str(now), base["tables"], base["totals"])
            return self._outcomes(plan, None)
        # Parsed lines are about a fiftieth of the bytes read, and are needed three times.
        read = stage(R.parse_lines(R.read_tails(todo)), "parsed")
        problems = stage(read.where(F.col("problem").isNotNull()).groupBy("file_path").agg(F.min(F.col("problem") == "missing").alias("lost")), "problems")
        work = stage(todo.join(problems, "file_path", "left_anti"), "work")
        parsed = read.join(problems, "file_path", "left_anti").drop("problem")
        ends = R.tail_ends(parsed)
        records = stage(R.identify(R.number_tails(parsed, work), owner), "records")

        touched = work.select("session_id", "plan", "file_path", "file_name", "size", "mtime", "head_sha256", "offset", "line_count").join(ends, "file_path", "left")
        fresh, new_chunks = self._merged(base, records, touched, now, owner)
        gone = plan.where(F.col("plan") == "prune").select("session_id")
        self._write(base, str(now), fresh, new_chunks, work.where(F.col("plan") == "full").select("session_id").unionByName(gone), gone)
        return self._outcomes(plan, problems, new_chunks, fresh)

    def add_records(self, records: DataFrame, now, owner=None, attempts: int = 5) -> int:
        """Append records that come without files, as a stream brings them, to all tables at once; returns how many were new.

        A session's records come in order of ``seq``. Those up to the last one stored are left out, so a batch may come again."""
        def work(base: dict) -> int:
            batch = stage(records, "batch")
            near = self._near("sessions", base, batch.select("session_id"))
            seen = near.select("session_id", F.col("state.last_seq").alias("_seen"))
            new = stage(batch.join(seen, "session_id", "left").where(F.col("_seen").isNull() | (F.col("seq") > F.col("_seen"))).drop("_seen"), "new-records")
            n = new.count()
            if n:
                none = {c: F.lit(None).cast(t) for c, t in (("head_sha256", "string"), ("parse_offset", "bigint"))}
                counts = new.groupBy("session_id").agg(F.max("file_path").alias("file_path"), F.max("file_name").alias("file_name"), F.count("*").alias("new_lines"), F.max("ts").alias("mtime"))
                known = near.select("session_id", F.col("line_count").alias("line_count"))
                touched = counts.join(known, "session_id", "left").withColumns({"plan": F.lit("resume"), "offset": F.lit(0).cast("bigint"), "size": F.lit(None).cast("bigint"), "line_count": F.coalesce("line_count", F.lit(0)), **none})
                own = new if "owner" in new.columns else new.withColumn("owner", owner if owner is not None else F.lit(""))
                fresh, chunks = self._merged(base, own, touched, now, owner)
                self._write(base, str(now), fresh, chunks, fresh.select("session_id").limit(0), fresh.select("session_id").limit(0))
            return n

        return self._retried(work, attempts)

    def _near(self, table: str, version: dict, sessions: DataFrame, **where) -> DataFrame:
        """Rows of some sessions; only their folders are opened."""
        rows = self._read(table, version)
        for column, value in where.items():
            rows = rows.where(F.col(column) == value)
        # At most one small integer per bucket of the layout.
        wanted = sessions.select("session_id").distinct()
        numbers = [r.b for r in wanted.select(sinks.bucket_of(F.col("session_id"), self.buckets).alias("b")).distinct().collect()]
        return self._alive(rows.where(F.col("bucket").isin(numbers)).join(wanted, "session_id", "left_semi"), self._deaths(version))

    def _merged(self, base: dict, records: DataFrame, touched: DataFrame, now, owner) -> tuple[DataFrame, DataFrame]:
        """New session rows and new chunks of records that follow what is stored."""
        tail = stage(S.session_state(records, ("session_id",)), "tail")
        touched = stage(touched, "touched")
        resumed = self._near("sessions", base, touched.where(F.col("plan") == "resume")).select("session_id", "state.*")
        merged = M.merge_states(resumed, tail).join(touched, "session_id", "right")
        merged = merged.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("message_count", "malformed_count")})
        owner_of = owner if owner is not None else F.lit("")
        done = S.finish_sessions(merged.withColumns({
            "owner": owner_of,
            "state": F.struct(*[F.col(c) for c in S.STATE_COLUMNS]),
        }))
        bucket = sinks.bucket_of(F.col("session_id"), self.buckets).alias("bucket")
        fresh = stage(done.select(
            "session_id", "owner", "file_path", "file_name", "title", "title_source",
            F.col("custom_title.text").alias("custom_title"), F.col("ai_title.text").alias("ai_title"),
            F.col("first_prompt.text").alias("first_prompt"), "folder_display", "folder_key", "folder_source", "git_branch",
            X.empty_to_null(F.col("last_prompt.text")).alias("last_prompt"),
            "first_activity", "last_activity", "message_count", F.col("size").alias("file_size"), "mtime", "head_sha256",
            F.coalesce("parse_offset", "offset").cast("bigint").alias("parse_offset"),
            (F.col("line_count") + F.coalesce("new_lines", F.lit(0))).cast("bigint").alias("line_count"), "parse_error", F.lit(now).cast("timestamp").alias("indexed_at"), "state",
            bucket,
        ), "fresh")
        chunks = C.message_chunks(records).withColumn("derived", F.lit(0)).unionByName(C.derived_chunks(fresh).withColumn("derived", F.lit(1)))
        return fresh, stage(chunks.withColumn("bucket", bucket), "chunks")

    def _write(self, base: dict, now: str, fresh: DataFrame, new_chunks: DataFrame, replaced: DataFrame, gone: DataFrame) -> None:
        """Append a pass to all tables and make it current. ``replaced`` names sessions whose old chunks no longer count."""
        number = base["number"] + 1
        known = bool(base["tables"].get("sessions"))
        totals = {"chunks": 0, "tokens": 0, "dead": 0} | base["totals"]
        postings = stage(I.build_postings(I.forward_index(new_chunks)).withColumn("token_bucket", I.token_bucket(F.col("token"), self.token_buckets)), "postings")
        changes = postings.select("token", F.lit(1).alias("df"))
        # A token stands in its posting once per occurrence, so texts need not be read again to count them.
        come = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).first()
        totals["chunks"], totals["tokens"] = totals["chunks"] + new_chunks.count(), totals["tokens"] + come.tokens
        tables = {t: list(base["tables"].get(t, [])) for t in SCHEMAS}
        if known:
            produced = new_chunks.where("derived = 1").select("session_id", "kind").distinct()
            replaced = stage(replaced.distinct(), "replaced")
            deaths = fresh.select("session_id").unionByName(gone).select("session_id", F.lit(SESSION_ROW).alias("kind"))
            deaths = deaths.unionByName(replaced.select("session_id", F.lit(ALL_CHUNKS).alias("kind"))).unionByName(produced)
            deaths = stage(deaths.withColumn("died", F.lit(number).cast("bigint")), "deaths")
            # Titles, folders and last prompts of the touched sessions, and all chunks of the replaced ones, have been counted and go.
            old = self._near("chunks", base, produced, derived=1).join(produced, ["session_id", "kind"], "left_semi")
            old = old.unionByName(self._near("chunks", base, replaced)) if not replaced.isEmpty() else old
            old = stage(I.forward_index(old.dropDuplicates(["session_id", "chunk_no"])), "dead")
            went = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
            totals = {"chunks": totals["chunks"] - went.n, "tokens": totals["tokens"] - went.tokens, "dead": totals["dead"] + went.n}
            changes = changes.unionByName(I.build_postings(old).select("token", F.lit(-1).alias("df")))
            tables["deaths"] += self.tables.write("deaths", deaths.coalesce(1), number, number, [])
        letter = F.pmod(F.xxhash64(F.left("token", F.lit(1))), F.lit(LETTER_BUCKETS)).cast("int").alias("letter_bucket")
        changes = self._vocabulary(changes.select("token", "df", letter))
        for table, rows in (("sessions", fresh), ("chunks", new_chunks), ("postings", postings), ("vocabulary", changes)):
            tables[table] += self.tables.write(table, rows, number, number, LAYOUT[table], ORDER.get(table, ()))
        self.tables.commit(base, now, *self._merge(base, tables, totals, number))

    def _merge(self, base: dict, tables: dict[str, list[dict]], totals: dict, number: int) -> tuple[dict, dict]:
        """Merge small segments, or all of them where too much no longer counts, and drop deaths that nothing stored can meet."""
        written, tables = tables, dict(tables)
        # The pass's own deaths count here, before they are current.
        deaths = self._deaths({"tables": tables})
        whole = totals["dead"] > self.most_dead * max(1, totals["chunks"])
        for table in SCHEMAS:
            segments = tables[table]
            chosen = sinks.to_merge(segments)
            if whole and table in ("sessions", "chunks", "postings"):
                # What this pass wrote holds nothing that no longer counts, and stays as it is unless it is merged anyway.
                chosen = [s for s in segments if s in base["tables"].get(table, []) or s in chosen]
            if not chosen or table == "deaths":
                continue
            rows = self.tables.read(table, SCHEMAS[table], chosen)
            rows = self._vocabulary(rows) if table == "vocabulary" else self._alive(rows, deaths).drop("born")
            born = max(int(s["pass"][:12]) for s in chosen)
            kept = [s for s in segments if s not in chosen]
            merged = self.tables.write(table, rows, born, number, LAYOUT[table], ORDER.get(table, ()))
            tables[table] = sorted([*kept, *merged], key=lambda s: s["pass"])
        if whole:
            totals = totals | {"dead": 0}
        needed = min((s["clean"] for t in ("sessions", "chunks", "postings") for s in tables[t]), default=number)
        deaths_left = [s for s in tables["deaths"] if int(s["pass"][:12]) > needed]
        if chosen := sinks.to_merge(deaths_left):
            rows = self.tables.read("deaths", DEATH_SCHEMA, chosen).groupBy("session_id", "kind").agg(F.max("died").alias("died"))
            merged = self.tables.write("deaths", rows.coalesce(1), max(int(s["pass"][:12]) for s in chosen), number, [])
            deaths_left = [s for s in deaths_left if s not in chosen] + merged
        # What this pass wrote and has merged already was never current.
        tables["deaths"] = deaths_left
        for table, segments in written.items():
            for s in segments:
                if s not in tables[table] and s not in base["tables"].get(table, []):
                    delete(self.spark, f"{self.path}/{table}/pass={s['pass']}")
        return tables, totals

    def compact(self, now, attempts: int = 5) -> bool:
        """Leave out for good what no longer counts; does nothing where there is nothing to leave out."""
        def work(base: dict) -> bool:
            if not base["totals"].get("dead"):
                return False
            most, self.most_dead = self.most_dead, -1.0
            try:
                self.tables.commit(base, str(now), *self._merge(base, {t: base["tables"].get(t, []) for t in SCHEMAS}, base["totals"], base["number"]))
            finally:
                self.most_dead = most
            return True

        return self._retried(work, attempts)

    def _outcomes(self, plan: DataFrame, problems: DataFrame | None, new_chunks: DataFrame | None = None, fresh: DataFrame | None = None) -> DataFrame:
        read = plan.select("session_id", "file_path", F.coalesce("readable", F.lit(True)).alias("opened"), F.coalesce("missing", F.lit(False)).alias("gone"), "offset")
        if problems is None:
            read = read.select("session_id", F.col("opened").alias("readable"), F.col("gone").alias("missing"), F.lit(False).alias("has_message"), F.lit(None).cast("bigint").alias("chunks"),
                               F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("parse_error"))
            return M.outcomes(plan.select("session_id", "plan", "reason"), read)
        written = new_chunks.groupBy("session_id").agg(F.count("*").alias("chunks"), F.bool_or(~F.col("kind").isin(K.KIND_TITLE, K.KIND_FOLDER)).alias("has_message"))
        read = (
            read.join(problems, "file_path", "left")
            .join(written, "session_id", "left")
            .join(fresh.select("session_id", "parse_offset", "parse_error"), "session_id", "left")
            .select("session_id", (F.col("opened") & F.col("lost").isNull()).alias("readable"), (F.col("gone") | F.coalesce("lost", F.lit(False))).alias("missing"),
                    "has_message", "chunks", (F.col("parse_offset") - F.col("offset")).alias("bytes"), "parse_error")
        )
        return M.outcomes(plan.select("session_id", "plan", "reason"), read)
