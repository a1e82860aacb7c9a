"""Daily and weekly recaps, for every owner and any number of days at once.

Everything is keyed by (owner, day) from the first shuffle on. Chunks are merged into messages per
(session, instant), so a session that holds a third of all rows is spread over its instants.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sessionlens import constants as K
from sessionlens.functions import text as X, time as T
from sessionlens.session import stage

SESSION = ("owner", "session_id")
PROJECT_DAY = ("owner", "day", "project_key")


@dataclass(frozen=True)
class Calendar:
    zone: str = "UTC"
    day_start: int = K.DAY_START_HOUR

    def day_of(self, ts: Column) -> Column:
        return T.working_day(ts, self.zone, self.day_start)

    def local(self, ts: Column) -> Column:
        return T.to_local(ts, self.zone)


# ---------------------------------------------------------------- messages and days


def merge_messages(chunks: DataFrame, calendar: Calendar) -> DataFrame:
    """Chunks back to messages: neighbours of one kind and instant are joined by a line feed.

    In reading order all chunks of an instant are neighbours, so the merge never looks beyond it.
    """
    said = chunks.where(F.col("kind").isin(K.KIND_USER_PROMPT, K.KIND_ASSISTANT_TEXT) & F.col("ts").isNotNull())
    instant = W.partitionBy(*SESSION, "ts").orderBy("chunk_no")
    starts = F.coalesce(F.lag("kind").over(instant) != F.col("kind"), F.lit(True)).cast("int")
    runs = said.select(*SESSION, "ts", "kind", "chunk_no", "text", starts.alias("starts")).withColumn(
        "run", F.sum("starts").over(instant.rowsBetween(W.unboundedPreceding, 0))
    )
    pieces = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    return (
        runs.groupBy(*SESSION, "ts", "run", "kind")
        .agg(F.min("chunk_no").alias("chunk_no"), F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"))
        .select("owner", calendar.day_of(F.col("ts")).alias("day"), "session_id", "ts", "chunk_no", "kind", "text")
    )


def clean_messages(messages: DataFrame) -> DataFrame:
    """Adds ``prompt``: what a person typed, NULL for replies, notices and bare envelopes."""
    return messages.withColumn("prompt", F.when(F.col("kind") == K.KIND_USER_PROMPT, X.clean_prompt(F.col("text"))))


def active_days(cleaned: DataFrame) -> DataFrame:
    """Days on which an owner typed something."""
    return cleaned.where(F.col("prompt").isNotNull()).select("owner", "day").distinct()


def adjacent_days(days: DataFrame) -> DataFrame:
    """Previous and next active day of each active day."""
    order = W.partitionBy("owner").orderBy("day")
    return days.select("owner", "day", F.lag("day").over(order).alias("previous_day"), F.lead("day").over(order).alias("next_day"))


def _within(day: Column, end: Column, scan_days: int | None) -> Column:
    """Whether a day is one of the ``scan_days`` that end with ``end``; without a number all are."""
    return F.lit(True) if scan_days is None else day >= F.date_sub(end, scan_days - 1)


def focus_days(days: DataFrame, requests: DataFrame, scan_days: int | None = None) -> DataFrame:
    """``(owner, today, requested NULL)`` to the day to report and its neighbours.

    A requested day is reported even when nothing happened on it; otherwise the latest active day
    before today is taken. ``scan_days`` is how far back a day is looked for, without limit by default.

    Requests stand among the active days of their owner as marks, and look at the nearest day before and after them, so
    many requests of an owner with many days cost their sum, not their product.
    """
    latest = _beside(days, requests.withColumn("mark", F.col("today")))
    recent = F.when(_within(F.col("before"), F.date_sub("today", 1), scan_days), F.col("before"))
    focus = latest.select("owner", "today", F.coalesce("requested", recent).alias("focus")).where(F.col("focus").isNotNull()).distinct()
    placed = _beside(days, focus.withColumn("mark", F.col("focus")))
    return placed.select(
        "owner", "today", "focus",
        F.when(_within(F.col("before"), F.col("focus"), scan_days), F.col("before")).alias("previous_day"),
        F.when(F.col("after") <= F.col("today"), F.col("after")).alias("next_day"),
        F.coalesce(F.col("here") == F.col("mark"), F.lit(False)).alias("is_active"),
    )


def _beside(days: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks (owner, mark, ...) with the nearest active days: ``before`` and ``after`` are other days, ``here`` is the last one up to the mark."""
    carried = F.struct(*[F.col(c) for c in marks.columns if c != "owner"])
    empty = F.lit(None).cast(marks.select(carried.alias("m")).schema["m"].dataType)
    rows = marks.select("owner", F.col("mark").alias("at"), carried.alias("m"), F.lit(None).cast("date").alias("day")).unionByName(
        days.select("owner", F.col("day").alias("at"), empty.alias("m"), "day"))
    # A range counts all rows of one date alike; days are numbers there.
    order = W.partitionBy("owner").orderBy(F.unix_date("at"))
    upto, below, above = order.rangeBetween(W.unboundedPreceding, 0), order.rangeBetween(W.unboundedPreceding, -1), order.rangeBetween(1, W.unboundedFollowing)
    found = rows.select("owner", "m", F.max("day").over(upto).alias("here"), F.max("day").over(below).alias("before"), F.min("day").over(above).alias("after"))
    return found.where(F.col("m").isNotNull()).select("owner", "m.*", "here", "before", "after")


def every_active_day(days: DataFrame) -> DataFrame:
    """Each active day as a focus of its own, told on the day after."""
    return days.select("owner", F.date_add("day", 1).alias("today"), F.col("day").alias("focus"))


def recap_frames(days: DataFrame, focus: DataFrame, lookback: int = K.LOOKBACK_DAYS, scan_days: int | None = None) -> DataFrame:
    """``(owner, today, focus, day, age)``: the focus day (age 0) and the ``lookback`` active days before it.

    Active days are numbered per owner, so a focus day finds the days before it by number.
    """
    numbered = days.withColumn("n", F.row_number().over(W.partitionBy("owner").orderBy("day")))
    marks = numbered.select("owner", "day", "n", F.lit(None).cast("date").alias("today")).unionByName(
        focus.select("owner", F.col("focus").alias("day"), F.lit(None).cast("int").alias("n"), "today")
    )
    # Days strictly before the mark: a mark sorts ahead of the active day of the same date.
    before = W.partitionBy("owner").orderBy("day", F.col("n").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    placed = (
        marks.withColumn("upto", F.coalesce(F.last("n", ignorenulls=True).over(before), F.lit(0)))
        .where(F.col("n").isNull())
        .select("owner", "today", F.col("day").alias("focus"), "upto")
    )
    wanted = placed.select("owner", "today", "focus", "upto", F.explode(F.sequence(F.greatest(F.col("upto") - lookback + 1, F.lit(1)), F.greatest(F.col("upto"), F.lit(1)))).alias("n"))
    earlier = (
        wanted.where((F.col("n") <= F.col("upto")) & (F.lit(lookback) > 0)).join(numbered, ["owner", "n"])
        .where(_within(F.col("day"), F.col("focus"), scan_days))
        .select("owner", "today", "focus", "day", (F.col("upto") - F.col("n") + 1).alias("age"))
    )
    own = focus.select("owner", "today", "focus", F.col("focus").alias("day"), F.lit(0).alias("age"))
    return own.unionByName(earlier)


# ---------------------------------------------------------------- sessions


def told_messages(cleaned: DataFrame) -> DataFrame:
    """Messages as recaps tell them: ``told`` is the shortened prompt or reply, ``size`` the length of a prompt (NULL for what is none),
    and ``same`` 128 bits of its lower-case form, by which prompts are told apart.

    Staged: cleaning is costly and several steps read the result, of which a row is a few hundred bytes however long its text.
    """
    is_prompt = F.col("kind") == K.KIND_USER_PROMPT
    lines = cleaned.withColumn("_line", F.when(is_prompt, F.col("prompt")).otherwise(X.collapse(F.col("text"))))
    told = F.when(is_prompt, X.truncate_words(F.col("_line"), K.KEY_PROMPT_LENGTH)).otherwise(X.truncate_words(F.col("_line"), K.OUTCOME_LENGTH))
    return stage(lines.select(
        "owner", "day", "session_id", "ts", "chunk_no", "kind", F.length("prompt").alias("size"),
        F.unhex(F.md5(F.lower("prompt").cast("binary"))).alias("same"), told.alias("told")), "told")


def key_prompts(told: DataFrame) -> DataFrame:
    """The three longest distinct prompts of a session's day, in the order they were typed."""
    first = told.where(F.col("size").isNotNull()).groupBy("owner", "day", "session_id", "same").agg(
        F.min(F.struct("ts", "chunk_no", "size", "told")).alias("p"))
    longest = W.partitionBy("owner", "day", "session_id").orderBy(F.col("p.size").desc(), "p.ts", "p.chunk_no")
    top = first.withColumn("n", F.row_number().over(longest)).where(F.col("n") <= K.KEY_PROMPT_COUNT)
    in_order = F.array_sort(F.collect_list("p"))
    return top.groupBy("owner", "day", "session_id").agg(F.transform(in_order, lambda p: p["told"]).alias("key_prompts"))


def session_days(told: DataFrame) -> DataFrame:
    """Counts, bounds and outcome per (owner, day, session); only days with a typed prompt.

    ``first_activity``/``last_activity`` cover all messages, ``first_prompt_at``/``last_prompt_at`` the
    recorded prompts: the focus day is told by the former, earlier days by the latter.
    """
    is_prompt = F.col("kind") == K.KIND_USER_PROMPT
    return (
        told.groupBy("owner", "day", "session_id")
        .agg(
            F.count("size").alias("prompt_count"),
            F.min("ts").alias("first_activity"),
            F.max("ts").alias("last_activity"),
            F.min(F.when(is_prompt, F.col("ts"))).alias("first_prompt_at"),
            F.max(F.when(is_prompt, F.col("ts"))).alias("last_prompt_at"),
            F.max(F.when(~is_prompt, F.struct("ts", "chunk_no", "told")))["told"].alias("outcome"),
        )
        .where(F.col("prompt_count") > 0)
        .withColumns({"outcome": X.empty_to_null(F.col("outcome")), "is_quick": F.col("prompt_count") <= K.QUICK_PROMPT_LIMIT})
    )


def folder_roots(folders: DataFrame, repos: DataFrame) -> DataFrame:
    """``(owner, folder_key)`` to the deepest repository root that contains the folder.

    A folder is exploded into its ancestors, which makes the containment test an equi-join.
    """
    distinct = folders.where(F.col("folder_key").isNotNull()).select("owner", "folder_key").distinct()
    above = distinct.select("owner", "folder_key", F.explode(X.folder_ancestors(F.col("folder_key"))).alias("root_key"))
    shown = X.folder_display(F.col("root"))
    roots = repos.select("owner", shown.alias("root"), X.folder_key(shown).alias("root_key"))
    return (
        above.join(roots, ["owner", "root_key"]).groupBy("owner", "folder_key")
        .agg(F.max(F.struct(F.length("root_key").alias("depth"), "root"))["root"].alias("root"))
    )


def session_projects(sessions: DataFrame, repos: DataFrame) -> DataFrame:
    """Per session: title, branch and the project it belongs to."""
    roots = folder_roots(sessions, repos)
    path = F.coalesce("root", "folder_display", F.lit(""))
    return (
        sessions.select(*SESSION, "title", "folder_display", "folder_key", "git_branch")
        .join(roots, ["owner", "folder_key"], "left")
        .select(*SESSION, "title", X.real_branch(F.col("git_branch")).alias("branch"), path.alias("path"), X.folder_key(path).alias("project_key"))
    )


def in_days(chunks: DataFrame, days: DataFrame, calendar: Calendar) -> DataFrame:
    """Chunks of the given (owner, day) only.

    The first and last instant of all days, two numbers, are filters of the scan, so files, row groups and pages of other
    times are not read where the table is ordered by time; what is left is matched by owner and day.
    """
    def instant(day: Column) -> Column:
        return F.unix_micros(T.day_start_instant(day, calendar.zone, calendar.day_start))

    span = days.agg(F.min(instant(F.col("day"))).alias("first"), F.max(instant(F.date_add("day", 1))).alias("end")).first()
    if span.first is None:
        return chunks.limit(0)
    near = chunks.where((F.col("ts") >= F.timestamp_micros(F.lit(span.first))) & (F.col("ts") < F.timestamp_micros(F.lit(span.end))))
    return near.withColumn("day", calendar.day_of(F.col("ts"))).join(days.select("owner", "day").distinct(), ["owner", "day"], "left_semi").drop("day")


def focused(chunks: DataFrame, requests: DataFrame, calendar: Calendar, lookback: int = K.LOOKBACK_DAYS, scan_days: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Focus days, frames and told messages for requests (owner, today, requested): prompts tell which days were active, and replies
    are read for focus days alone.

    A focus day is told by all messages of the day, the days before it by their prompts, of which those of one instant are one
    message whatever was replied between them. A day that is the focus of one request is read with its replies for all.
    """
    prompts = told_messages(clean_messages(merge_messages(chunks.where(F.col("kind") == K.KIND_USER_PROMPT), calendar)))
    days = prompts.where(F.col("size").isNotNull()).select("owner", "day").distinct()
    focus = stage(focus_days(days, requests, scan_days), "focus")
    frames = stage(recap_frames(days, focus.select("owner", "today", "focus"), lookback, scan_days), "frames")
    at = focus.select("owner", F.col("focus").alias("day")).distinct()
    own = told_messages(clean_messages(merge_messages(in_days(chunks, at, calendar), calendar)))
    # Earlier days of a frame only.
    earlier = frames.select("owner", "day").distinct().join(at, ["owner", "day"], "left_anti")
    return focus, frames, own.unionByName(prompts.join(earlier, ["owner", "day"], "left_semi").select(own.columns))


def session_recaps(cleaned: DataFrame, projects_of_sessions: DataFrame) -> DataFrame:
    """The account of each session's day."""
    return recaps_of(told_messages(cleaned), projects_of_sessions)


def recaps_of(told: DataFrame, projects_of_sessions: DataFrame) -> DataFrame:
    return (
        session_days(told)
        .join(key_prompts(told), ["owner", "day", "session_id"])
        .join(projects_of_sessions, list(SESSION))
    )


# ---------------------------------------------------------------- projects


def commits_by_day(commits: DataFrame, calendar: Calendar) -> DataFrame:
    """Commits keyed by project and working day."""
    root = X.folder_display(F.col("repo_root"))
    return commits.select("owner", calendar.day_of(F.col("ts")).alias("day"), X.folder_key(root).alias("project_key"), "ts", "sha", "subject")


def _ordered(items: Column, name: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(items)), lambda i: i[name])


def project_recaps(recaps: DataFrame, commits: DataFrame) -> DataFrame:
    """One row per (owner, day, project), positioned within the day: busiest first."""
    # Per branch first, so what is collected per project is its branches, not its sessions.
    by_branch = recaps.groupBy(*PROJECT_DAY, "branch").agg(
        F.min(F.struct("session_id", "path")).alias("path"),
        F.count("*").alias("session_count"),
        F.count_if("is_quick").alias("quick_count"),
        F.sum("prompt_count").alias("prompt_count"),
        F.min("first_activity").alias("first_activity"),
        F.max("last_activity").alias("last_activity"),
        F.max("last_prompt_at").alias("last_prompt_at"),
        F.min(F.struct("first_activity", "session_id")).alias("o"),
    )
    totals = by_branch.groupBy(*PROJECT_DAY).agg(
        F.min("path")["path"].alias("path"),
        *[F.sum(c).alias(c) for c in ("session_count", "quick_count", "prompt_count")],
        F.min("first_activity").alias("first_activity"),
        F.max("last_activity").alias("last_activity"),
        F.max("last_prompt_at").alias("last_prompt_at"),
        _ordered(F.when(F.col("branch").isNotNull(), F.struct("o", "branch")), "branch").alias("branches"),
    )
    counted = commits.groupBy(*PROJECT_DAY).agg(F.count("*").alias("commit_count"))
    day = W.partitionBy("owner", "day")
    busiest = day.orderBy(F.col("prompt_count").desc(), F.col("last_activity").desc(), "project_key")
    earlier = day.orderBy(F.col("prompt_count").desc(), F.col("last_prompt_at").desc(), "project_key")
    return (
        totals.join(counted, list(PROJECT_DAY), "left")
        .withColumns({
            "name": X.base_name(F.col("path")),
            "commit_count": F.coalesce("commit_count", F.lit(0)),
            "pos": F.row_number().over(busiest),
            "earlier_pos": F.row_number().over(earlier),
        })
    )


def work_titles(recaps: DataFrame, first: str) -> DataFrame:
    """Distinct titles of the sessions that were more than a quick question, by first activity."""
    return (
        recaps.where(~F.col("is_quick")).groupBy(*PROJECT_DAY, "title")
        .agg(F.min(F.struct(first, "session_id")).alias("o"))
        .groupBy(*PROJECT_DAY).agg(_ordered(F.struct("o", "title"), "title").alias("titles"))
    )


def week_rollup(frames: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects over the focus day and the active days before it, busiest first."""
    week = ["owner", "today", "focus", "project_key"]
    entries = frames.join(projects, ["owner", "day"])
    # At most one list of branches per day of the frame is collected, and the newest day names a branch first.
    lists = F.transform(F.array_sort(F.collect_list(F.struct("age", "branches"))), lambda d: d["branches"])
    totals = entries.groupBy(*week).agg(
        F.max(F.struct("day", "name", "path")).alias("latest"),
        F.count("*").alias("active_days"),
        F.sum("session_count").alias("session_count"),
        F.sum("quick_count").alias("quick_count"),
        F.sum("prompt_count").alias("prompt_count"),
        F.sum("commit_count").alias("commit_count"),
        F.array_distinct(F.flatten(lists)).alias("branches"),
    )
    order = W.partitionBy("owner", "today", "focus").orderBy(F.col("prompt_count").desc(), F.col("latest.day").desc(), "project_key")
    return (
        totals.withColumn("pos", F.row_number().over(order))
        .select(
            *week, F.col("latest.name").alias("name"), F.col("latest.path").alias("path"), F.col("latest.day").alias("last_day"),
            "active_days", "session_count", "quick_count", "prompt_count", "commit_count",
            "branches", "pos",
        )
    )


def day_totals(projects: DataFrame) -> DataFrame:
    """Sessions, commits and project names per (owner, day): the row an earlier day is listed as."""
    return projects.groupBy("owner", "day").agg(
        F.sum("session_count").alias("sessions"),
        F.sum("commit_count").alias("commits"),
        F.array_join(_ordered(F.struct("earlier_pos", "name"), "name"), ", ").alias("projects"),
    )


def headings(frames: DataFrame, projects: DataFrame) -> DataFrame:
    """Focus and week headings per (owner, focus)."""
    per_day = frames.join(day_totals(projects), ["owner", "day"], "left")
    is_focus = F.col("age") == 0
    sums = per_day.groupBy("owner", "today", "focus").agg(
        F.sum(F.when(is_focus, F.col("sessions"))).alias("focus_sessions"),
        F.sum(F.when(is_focus, F.col("commits"))).alias("focus_commits"),
        F.count("sessions").alias("days"),
        F.sum("sessions").alias("week_sessions"),
        F.sum("commits").alias("week_commits"),
    )
    when = T.age_heading(F.col("focus"), F.col("today"))

    def commits(n: str) -> Column:
        return F.when(F.col(n) > 0, X.count_noun(F.col(n), "commit"))

    focus = F.when(F.col("focus_sessions").isNull(), F.concat(when, F.lit(" · no activity"))).otherwise(
        F.concat_ws(" · ", when, X.count_noun(F.col("focus_sessions"), "session"), commits("focus_commits")))
    week = F.when(F.col("days") == 0, F.lit("No activity")).otherwise(
        F.concat_ws(" · ", X.count_noun(F.col("days"), "active day"), X.count_noun(F.col("week_sessions"), "session"), commits("week_commits")))
    return sums.select("owner", "today", "focus", focus.alias("focus_heading"), week.alias("week_heading"))
