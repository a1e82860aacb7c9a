"""Recap rules on a small week. Zone UTC-3 without daylight saving; today is Monday, 2026-10-05."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import text as X
from sessionlens.operators import recap as R, recap_text as RT
from sessionlens.session import stage
from sessionlens.sources import commits as G

CALENDAR = R.Calendar("-03:00")
TODAY = dt.date(2026, 10, 5)


def at(day, clock):
    """A local clock time as a UTC text."""
    local = dt.datetime.fromisoformat(f"2026-{day} {clock}")
    return (local + dt.timedelta(hours=3)).isoformat(sep=" ")


def build(spark, said, sessions, commits=(), repos=()):
    rows, numbers = [], {}
    for session, when, kind, text in said:
        numbers[session] = numbers.get(session, 0) + 1
        rows.append(("me", session, numbers[session], kind, when, text))
    chunks = spark.createDataFrame(rows, "owner string, session_id string, chunk_no bigint, kind int, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    table = spark.createDataFrame([("me", *s) for s in sessions], "owner string, session_id string, title string, folder_display string, git_branch string")
    table = table.withColumn("folder_key", X.folder_key(F.col("folder_display")))
    log = spark.createDataFrame([("me", *c) for c in commits], "owner string, repo_root string, sha string, subject string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    roots = spark.createDataFrame([("me", r) for r in repos], "owner string, root string")
    cleaned = R.clean_messages(R.merge_messages(chunks, CALENDAR))
    recaps = stage(R.session_recaps(cleaned, R.session_projects(table, roots)), "recaps")
    daily = stage(R.commits_by_day(log, CALENDAR), "commits")
    return cleaned, recaps, stage(R.project_recaps(recaps, daily), "projects"), daily


def request(spark, day=None, today=TODAY):
    return spark.createDataFrame([("me", today, day)], "owner string, today date, requested date")


def asks(session, day, start, n, text="water row {}"):
    hour, minute = map(int, start.split(":"))
    return [(session, at(day, f"{hour:02d}:{minute + i:02d}"), 4, text.format(i)) for i in range(n)]


# Five people's worth of questions on three days: a harbour and its tide tables, told on a Wednesday.
TOLD = dt.date(2026, 6, 17)
SAID = (
    asks("berths", "06-16", "10:05", 4, "berth {} is taken") + asks("crane", "06-16", "14:00", 1, "Which crane lifts most?") + asks("fuel", "06-16", "14:30", 2, "fuel price {}")
    + asks("tables", "06-16", "18:40", 5, "tide of month {}") + [("tables", at("06-16", "18:50"), 5, "All twelve months are read.")]
    + asks("moon", "06-14", "09:00", 2, "moon phase {}") + asks("fees", "06-12", "11:00", 3, "fee of metre {}")
)
SESSIONS = [("berths", "Berth plan", "/srv/harbour", "berths"), ("crane", "Which crane?", "/srv/harbour/", None), ("fuel", "Fuel?", "/srv/harbour", None),
            ("tables", "Tide tables", "/srv/tides", "main"), ("moon", "Moon?", "/srv/tides", "main"), ("fees", "Mooring fees", "/srv/harbour", "HEAD")]
COMMITS = [("/srv/tides", "a1c4e77", "Read tables by month", at("06-16", "19:00")), ("/srv/tides", "b93d020", "Drop the old almanac", at("06-16", "19:30")),
           ("/srv/harbour", "77f0b1d", "Charge per metre", at("06-12", "12:00"))]


@pytest.fixture(scope="module")
def week(spark):
    cleaned, recaps, projects, commits = build(spark, SAID, SESSIONS, COMMITS, ["/srv/harbour", "/srv/tides"])
    days = stage(R.active_days(cleaned), "days")
    focus = stage(R.focus_days(days, request(spark, today=TOLD)), "focus")
    frames = stage(R.recap_frames(days, focus.select("owner", "today", "focus")), "frames")
    return days, focus, frames, recaps, projects, commits


def text(lines):
    return RT.assemble(lines).first().text


def test_the_latest_day_before_today_is_told(week):
    row = week[1].first()
    assert (str(row.focus), str(row.previous_day), row.next_day, row.is_active) == ("2026-06-16", "2026-06-14", None, True)


def test_a_day_with_two_projects(week):
    _, _, frames, recaps, projects, commits = week
    today, earlier = text(RT.day_lines(frames, recaps, projects, commits, CALENDAR)).split("\n\n")
    harbour, tides = today.split("\n- ")[1:]
    assert today.startswith("**Yesterday (Tue, Jun 16)**\n")
    assert harbour.splitlines() == ["**harbour** · `berths` · 3 sessions · 10:05–14:31", "  - Berth plan (4 prompts)", "  - _plus 2 quick questions_"]
    assert tides.splitlines() == ["**tides** · `main` · 1 session · 18:40–18:50", "  - Tide tables (5 prompts)", "  - Commits:",
                                  "    - `a1c4e77` Read tables by month", "    - `b93d020` Drop the old almanac"]
    # A day of quick questions only, and one with a commit.
    assert earlier.splitlines() == ["**Earlier**", "- **Sun, Jun 14**", "  - tides: 1 quick question", "- **Fri, Jun 12**", "  - harbour: Mooring fees · 1 commit"]


def test_a_week_of_three_days(week):
    _, _, frames, recaps, projects, commits = week
    lines = text(RT.week_lines(frames, R.week_rollup(frames, projects), recaps, projects, commits)).splitlines()
    assert lines[0] == "**Week of Fri, Jun 12 – Tue, Jun 16**"
    second = lines.index("- **tides** · `main` · 2 sessions over 2 days · 2 commits")
    assert lines[1:second] == ["- **harbour** · `berths` · 4 sessions over 2 days · 1 commit", "  - Tue, Jun 16: Berth plan", "  - Fri, Jun 12: Mooring fees",
                               "  - _plus 2 quick questions_", "  - Commits:", "    - `77f0b1d` Charge per metre"]
    assert lines[second + 1 : second + 3] == ["  - Tue, Jun 16: Tide tables", "  - _plus 1 quick question_"] and len(lines) == second + 6


def test_other_marks(week):
    _, _, frames, recaps, projects, commits = week
    plain = text(RT.day_lines(frames, recaps, projects, commits, CALENDAR, "plain")).splitlines()
    assert plain[0] == "Yesterday (Tue, Jun 16)" and not any(mark in line for line in plain for mark in "*`_")
    slack = text(RT.day_lines(frames, recaps, projects, commits, CALENDAR, "slack", with_prompts=True)).splitlines()
    at_title = slack.index("    ◦ Berth plan (4 prompts)")
    assert slack[at_title + 1 : at_title + 4] == [f'        ▪ "berth {i} is taken"' for i in range(3)]


def test_summary_input_and_headings(week):
    _, _, frames, recaps, projects, commits = week
    lines = text(RT.summary_lines(frames, recaps, projects, commits, CALENDAR)).splitlines()
    assert "### tides on main" in lines and "  < All twelve months are read." in lines and "2 brief exchanges left out" in lines
    assert lines.index("## Before: Fri, Jun 12") < lines.index("## Before: Sun, Jun 14") < lines.index("## Journal: Yesterday (Tue, Jun 16)")
    row = R.headings(frames, projects).first()
    assert (row.focus_heading, row.week_heading) == ("Yesterday · 4 sessions · 2 commits", "3 active days · 6 sessions · 3 commits")


def test_lines_sink(spark, week, tmp_path):
    _, _, frames, recaps, projects, commits = week
    lines = RT.day_lines(frames, recaps, projects, commits, CALENDAR)
    RT.write_texts(lines, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(f.read_text() for f in files) == text(lines)


def test_a_requested_empty_day(spark, week):
    days, _, _, recaps, projects, commits = week
    focus = R.focus_days(days, request(spark, dt.date(2026, 6, 15), TOLD))
    row = focus.first()
    assert (str(row.focus), row.is_active, str(row.previous_day), str(row.next_day)) == ("2026-06-15", False, "2026-06-14", "2026-06-16")
    frames = R.recap_frames(days, focus.select("owner", "today", "focus"), 1)
    assert text(RT.day_lines(frames, recaps, projects, commits, CALENDAR)).startswith("**Mon, Jun 15**\n_No activity on this day._\n\n**Earlier**\n- **Sun, Jun 14**\n")
    assert RT.summary_lines(frames, recaps, projects, commits, CALENDAR).count() == 0


def test_nothing_before_today(spark):
    cleaned, *_ = build(spark, asks("s", "10-05", "09:00", 1), [("s", "t", "/x", None)])
    assert R.focus_days(R.active_days(cleaned), request(spark)).count() == 0


def test_work_past_midnight_and_envelopes(spark):
    said = [("s", at("10-03", "01:30"), 4, "late work"), ("s", at("10-03", "05:00"), 4, "<notice>x</notice>"), ("s", at("10-03", "06:00"), 5, "reply only")]
    cleaned, *_ = build(spark, said, [("s", "t", "/x", None)])
    assert [str(r.day) for r in R.active_days(cleaned).collect()] == ["2026-10-02"]


def test_lookback_counts_active_days(spark):
    said = [x for d in ("08-03", "09-01", "09-20", "10-01", "10-02") for x in asks("s", d, "10:00", 1)]
    cleaned, *_ = build(spark, said, [("s", "t", "/x", None)])
    days = R.active_days(cleaned)
    frames = R.recap_frames(days, R.focus_days(days, request(spark)).select("owner", "today", "focus"), 3)
    assert [(str(r.day), r.age) for r in frames.orderBy("age").collect()] == [("2026-10-02", 0), ("2026-10-01", 1), ("2026-09-20", 2), ("2026-09-01", 3)]
    assert R.recap_frames(days, R.every_active_day(days), 0).count() == 5


def test_how_far_back_days_are_looked_for(spark):
    said = [("s", dt.datetime(y, 3, 1, 15).isoformat(sep=" "), 4, "words") for y in (1999, 2012, 2024)]
    cleaned, *_ = build(spark, said, [("s", "t", "/x", None)])
    days = R.active_days(cleaned)
    ask = request(spark, dt.date(2026, 10, 1))
    assert str(R.focus_days(days, ask).first().previous_day) == "2024-03-01" and R.focus_days(days, ask, 100).first().previous_day is None
    focus = R.focus_days(days, ask).select("owner", "today", "focus")
    assert R.recap_frames(days, focus, 9).count() == 4 and R.recap_frames(days, focus, 9, 6000).count() == 3


def test_split_prompts_and_key_prompts(spark):
    said = [("s", at("10-02", "10:00"), 4, "first half"), ("s", at("10-02", "10:00"), 4, "second half"),
            ("s", at("10-02", "10:01"), 4, "Same Words here"), ("s", at("10-02", "10:02"), 4, "same words HERE"),
            ("s", at("10-02", "10:03"), 4, "x" * 50), ("s", at("10-02", "10:04"), 4, "tiny"),
            ("s", at("10-02", "10:05"), 5, "old"), ("s", at("10-02", "10:06"), 5, "the **last**\nword")]
    _, recaps, projects, _ = build(spark, said, [("s", "t", None, None)])
    row = recaps.first()
    assert row.prompt_count == 5 and row.outcome == "the **last** word"
    assert row.key_prompts == ["first half second half", "Same Words here", "x" * 50]
    assert projects.first().name == "(folder unknown)"


def test_repositories_by_deepest_root(spark):
    folders = spark.createDataFrame([("me", k) for k in ("\\A\\B\\C", "\\A\\BC", "\\A", "\\Z")], "owner string, folder_key string")
    repos = spark.createDataFrame([("me", "/a"), ("me", "/a/b/"), ("you", "/z")], "owner string, root string")
    assert {r.folder_key: r.root for r in R.folder_roots(folders, repos).collect()} == {"\\A\\B\\C": "/a/b", "\\A\\BC": "/a", "\\A": "/a"}


def test_commit_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("abc1234\x1f2026-10-02T23:30:00-03:00\x1fFix \x1f things\nbroken line\nabc\x1fnot a date\x1fx\n\n")
    rows = G.read_commits(spark, str(tmp_path / "a.log")).select("sha", F.col("ts").cast("string"), "subject").collect()
    assert [tuple(r) for r in rows] == [("abc1234", "2026-10-03 02:30:00", "Fix \x1f things")]
    repos = G.resolve_author(spark.createDataFrame([("me", "/r", " ", "Ann [x]"), ("me", "/q", "ann@x.org", "Ann")], "owner string, root string, user_email string, user_name string"))
    log = spark.createDataFrame([("me", "/r", "Ann [x] <a@b>"), ("me", "/r", "Annx"), ("me", "/q", "Ann <ann@x.org>"), ("me", "/q", "Ann <other>")], "owner string, repo_root string, author string")
    assert sorted(r.author for r in G.own_commits(log, repos).collect()) == ["Ann <ann@x.org>", "Ann [x] <a@b>"]


def test_days_together_equal_days_alone(spark, week):
    days, _, _, recaps, projects, commits = week
    every = R.recap_frames(days, R.every_active_day(days))
    together = {r.focus: r.text for r in RT.assemble(RT.day_lines(every, recaps, projects, commits, CALENDAR)).collect()}
    for day in together:
        alone = R.recap_frames(days, R.every_active_day(days).where(F.col("focus") == F.lit(day)))
        assert text(RT.day_lines(alone, recaps, projects, commits, CALENDAR)) == together[day]


def messages(spark, rows):
    return spark.createDataFrame(rows, "owner string, session_id string, chunk_no bigint, kind int, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_replies_are_read_for_the_focus_day_only(spark):
    # Two prompts of one instant with a reply between them: two messages where the reply is read, one where it is not.
    rows = [("me", "s", 10 * d + i, kind, at(f"10-0{d}", "11:00"), f"{word} on {d}") for d in (1, 2) for i, (kind, word) in enumerate([(4, "first"), (5, "answer"), (4, "second")])]
    focus, frames, told = R.focused(messages(spark, rows), request(spark), CALENDAR)
    assert [(str(r.focus), str(r.previous_day)) for r in focus.collect()] == [("2026-10-02", "2026-10-01")]
    by_day = {str(r.day): (r.prompt_count, r.outcome) for r in R.session_days(told).collect()}
    assert by_day == {"2026-10-02": (2, "answer on 2"), "2026-10-01": (1, None)}
    prompts = {str(r.day): r.key_prompts for r in R.key_prompts(told).collect()}
    assert prompts == {"2026-10-02": ["first on 2", "second on 2"], "2026-10-01": ["first on 1 second on 1"]}
    # No request finds a day: nothing is told.
    assert R.focused(messages(spark, rows), request(spark, today=dt.date(2026, 10, 1)), CALENDAR)[2].count() == 0
    assert R.focused(messages(spark, []), request(spark), CALENDAR)[2].count() == 0


def test_many_requests_of_an_owner_look_at_the_nearest_days(spark):
    active = [dt.date(2026, 9, d) for d in (1, 2, 5, 9, 20)]
    days = spark.createDataFrame([(o, d) for o in ("a", "b") for d in active if o == "a" or d.day > 2], "owner string, day date")
    asked = [(o, dt.date(2026, 9, t), r and dt.date(2026, 9, r)) for o in ("a", "b", "none") for t in range(1, 30, 3) for r in (None, 2, 4, 20, 25)]
    for scan in (None, 4):
        want = set()
        for owner, today, requested in asked:
            own = {"a": active, "b": active[2:]}.get(owner, [])
            near = lambda d, end: scan is None or (end - d).days < scan
            focus = requested or max((d for d in own if d < today and near(d, today - dt.timedelta(1))), default=None)
            if focus:
                want.add((owner, today, focus, max((d for d in own if d < focus and near(d, focus)), default=None), min((d for d in own if focus < d <= today), default=None), focus in own))
        found = R.focus_days(days, spark.createDataFrame(asked, "owner string, today date, requested date"), scan).collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_the_scan_reads_the_asked_days_only(spark, tmp_path):
    rows = spark.range(30000).select(
        F.lit("me").alias("owner"), (F.col("id") % 7).cast("string").alias("session_id"), F.col("id").alias("chunk_no"), F.lit(4).alias("kind"),
        (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int") * 10)).alias("ts"), F.lit("said").alias("text"))
    for month in range(3):
        rows.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(month * 30))).sort("ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/chunks")
    day = spark.createDataFrame([("me", dt.date(2026, 2, 12))], "owner string, day date")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = R.in_days(spark.read.parquet(f"{tmp_path}/chunks"), day, CALENDAR)
        plan = found._jdf.queryExecution().executedPlan()
        n = found.count()
        counted = found.select("ts", "text")
        counted.collect()
        leaves = counted._jdf.queryExecution().executedPlan().collectLeaves()
        read = max(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if "parquet" in leaves.apply(i).toString())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = spark.read.parquet(f"{tmp_path}/chunks").where(CALENDAR.day_of(F.col("ts")) == F.lit("2026-02-12").cast("date")).count()
    # Each file spans 208 days from its month on, so two of three have rows of that day; of each a page of 20,000 rows is read.
    assert n == want > 0 and n <= read <= 40000, plan.toString()
