"""Scalar rules, each against a plain Python statement of the rule."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import scoring, text as X, time as T


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_collapse(spark):
    values = ["  a \t\n b\u00a0\u2003c\x00d\x85 ", "", "\n", "x", None, "a\u200bb"]
    assert column(spark, values, X.collapse) == ["a b c d", "", "", "x", None, "a\u200bb"]


def test_truncate(spark):
    long = "w" * 79 + " tail"
    assert column(spark, ["a" * 80, "a" * 81, long, "é" * 90], X.truncate) == ["a" * 80, "a" * 80 + "…", "w" * 79 + "…", "é" * 80 + "…"]


def test_truncate_words(spark):
    def plain(s, n):
        if len(s) <= n:
            return s
        space = s.rfind(" ", 0, n)
        return s[: space if space > n * 3 // 4 else n].rstrip() + "…"

    rng = random.Random(1)
    values = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    assert column(spark, values, lambda c: X.truncate_words(c, 40)) == [plain(v, 40) for v in values]


def test_clean_prompt(spark):
    cases = {
        "<ide_opened_file>x</ide_opened_file>fix\nthe  bug": "fix the bug",
        "<a-b c='1'>in\nside</a-b > <z>1</z>": None,
        "<Div>kept</Div>": "<Div>kept</Div>",
        "<b>open only": "<b>open only",
        "<a>1</b> x </a> y": "y",
        "[Request interrupted by user]": None,
        "say [Request interrupted": "say [Request interrupted",
        "Caveat: The messages below were": None,
        " \n ": None,
    }
    assert column(spark, list(cases), X.clean_prompt) == list(cases.values())


def test_folders(spark):
    cases = {" C:\\git\\App\\ ": "C:\\git\\App", "/work/app//": "/work/app", "///": "/", "\\": "\\", "c:/": "c:\\", "C:": "C:\\", "  ": None, "": None, "x": "x"}
    assert column(spark, list(cases), X.folder_display) == list(cases.values())
    assert column(spark, ["/work/App", "C:\\Work/app"], X.folder_key) == ["\\WORK\\APP", "C:\\WORK\\APP"]
    names = {"/work/app": "app", "C:\\": "C:\\", "/": "/", "": "(folder unknown)", None: "(folder unknown)", "app": "app", "C:\\git\\x": "x"}
    assert column(spark, list(names), X.base_name) == list(names.values())


def test_ancestors(spark):
    got = column(spark, ["\\WORK\\APP\\SRC", "C:\\GIT", "\\", "C:\\"], X.folder_ancestors)
    assert [sorted(g) for g in got] == [["\\", "\\WORK", "\\WORK\\APP", "\\WORK\\APP\\SRC"], ["C:\\", "C:\\GIT"], ["\\"], ["C:\\"]]


def test_branch_and_counts(spark):
    assert column(spark, ["main", "HEAD", " ", None, "head"], X.real_branch) == ["main", None, None, None, "head"]
    assert column(spark, [0, 1, 2], lambda c: X.count_noun(c, "commit"), "int") == ["0 commits", "1 commit", "2 commits"]


def test_titles(spark):
    rows = spark.createDataFrame([(" c ", "a", "p", "f"), (None, " \n", "p  q", "f"), ("", None, None, "f"), (None, None, "\t", " ")], "c string, a string, p string, f string")
    text, source = X.resolve_title(*map(F.col, "capf"))
    assert [tuple(r) for r in rows.select(text, source).collect()] == [("c", 1), ("p q", 3), ("f", 4), ("Untitled session", 0)]


def test_tokens_fold_case_and_accents(spark):
    assert column(spark, ["Depósito ÁÉÍ-ñandú x1_y2 naïve e\u0301t\u0301"], X.tokens) == [["deposito", "aei", "nandu", "x1", "y2", "naive", "et"]]


def test_description(spark):
    rows = spark.createDataFrame([("**Done**, see `x`", ["p"]), (None, ["first", "second"]), (None, []), (" ", ["p"])], "o string, k array<string>")
    assert [r[0] for r in rows.select(X.describe_session(F.col("o"), F.col("k"))).collect()] == ["Done, see x", "first", None, None]


def stamps(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").withColumn("v", F.col("v").cast("timestamp"))
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_working_day_across_daylight_saving(spark):
    zone = "America/New_York"
    # 2026-03-08 02:00 does not exist there; 2026-11-01 01:00 happens twice.
    got = stamps(spark, ["2026-03-08 07:59:00", "2026-03-08 08:00:00", "2026-01-05 08:59:00", "2026-01-05 09:00:00"], lambda c: T.working_day(c, zone, 4))
    assert [str(d) for d in got] == ["2026-03-07", "2026-03-08", "2026-01-04", "2026-01-05"]
    days = spark.sql("select date'2026-03-08' d, 2 h union all select date'2026-11-01', 1 union all select date'2026-07-01', 4")
    for hour, day, want in ((2, "2026-03-08", "2026-03-08 07:00:00"), (1, "2026-11-01", "2026-11-01 05:00:00"), (4, "2026-07-01", "2026-07-01 08:00:00")):
        one = days.where(F.col("d") == F.lit(day)).select(T.day_start_instant(F.col("d"), zone, hour).cast("string")).first()[0]
        assert one == want


def test_relative_age(spark):
    now = F.lit("2026-10-05 12:00:00").cast("timestamp")
    cases = {"2026-10-05 11:59:01": "just now", "2026-10-05 11:59:00": "1 minute ago", "2026-10-05 11:00:01": "59 minutes ago", "2026-10-05 11:00:00": "1 hour ago",
             "2026-10-04 12:00:01": "23 hours ago", "2026-10-04 12:00:00": "1 day ago", "2026-09-28 12:00:01": "6 days ago", "2026-09-28 12:00:00": "2026-09-28",
             "2026-10-05 12:00:01": "2026-10-05", None: "unknown"}
    assert stamps(spark, list(cases), lambda c: T.relative_age(c, now)) == list(cases.values())


def test_labels(spark):
    row = spark.sql("select date'2026-10-05' t, date'2026-10-04' y, date'2026-10-02' f").select(
        T.day_label(F.col("t"), F.col("t")), T.day_label(F.col("y"), F.col("t")), T.day_label(F.col("f"), F.col("t")),
        T.week_label(F.col("f"), F.col("t")), T.week_label(F.col("f"), F.col("f")), T.age_heading(F.col("f"), F.col("t")), T.age_heading(F.col("t"), F.col("f"))).first()
    assert list(row) == ["Today so far (Mon, Oct 5)", "Yesterday (Sun, Oct 4)", "Fri, Oct 2", "Week of Fri, Oct 2 – Mon, Oct 5", "Week of Fri, Oct 2", "3 days ago", "Later"]


@pytest.mark.parametrize("weight,decay", [(0.6, 30.0), (0.0, 30.0), (0.6, 0.0)])
def test_recency(spark, weight, decay):
    now = dt.datetime(2026, 10, 5, 12)
    values = ["2026-10-05 12:00:00", "2026-09-05 12:00:00", "2026-10-06 12:00:00", None]
    got = stamps(spark, values, lambda c: scoring.recency_multiplier(c, F.lit("2026-10-05 12:00:00").cast("timestamp"), weight, decay))
    for value, have in zip(values, got):
        age = max(0.0, (now - dt.datetime.fromisoformat(value)).total_seconds() / 86400) if value else 0
        assert have == pytest.approx(1 + weight * math.exp(-age / decay) if value and weight > 0 and decay > 0 else 1.0)


def test_folder_patterns_stand_once_in_a_plan(spark):
    """Each pattern is asked once or twice per row, in generated methods that stay small; before, it stood in the plan for every use."""
    rows = spark.createDataFrame([(" /a/b// ",), ("/",), ("c:\\",), ("  ",), (None,), ("x",), ("c:",)], "path string")
    shown = rows.select(X.folder_key(X.folder_display(F.col("path"))).alias("key"))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[\\\\/]+$") == 1 and plan.count("[\\p{Z}\\s") <= 4
    assert [r.key for r in shown.collect()] == ["\\A\\B", "\\", "C:\\", None, None, "X", "C:\\"]
