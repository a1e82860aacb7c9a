"""Exported commit logs: one commit per line, fields separated by the unit separator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEPARATOR = "\x1f"


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """``sha, author date, subject`` lines to commits; lines without three fields or a date are dropped."""
    fields = F.split(F.trim(F.col(value)), SEPARATOR, 3)
    return (
        lines.withColumns({"fields": fields})
        .withColumns({"ts": F.try_to_timestamp(F.get("fields", F.lit(1)))})
        .where((F.size("fields") == 3) & F.col("ts").isNotNull())
        .withColumns({"sha": F.get("fields", F.lit(0)), "subject": F.get("fields", F.lit(2))})
        .drop("fields", value)
    )


def read_commits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Logs laid out as ``.../<owner>/<anything>.log``; the path stays as ``file_path``."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file_path"))
    return parse_log(lines)


def commits_between(commits: DataFrame, start: Column, end: Column) -> DataFrame:
    """Author date in ``[start, end)``."""
    return commits.where((F.col("ts") >= start) & (F.col("ts") < end))


def resolve_author(repos: DataFrame) -> DataFrame:
    """The author to look for: the configured e-mail, else the name."""
    email, name = (F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("user_email", "user_name"))
    return repos.withColumn("author", F.coalesce(email, name)).drop("user_email", "user_name")


def own_commits(commits: DataFrame, repos: DataFrame) -> DataFrame:
    """Commits whose author field contains the repository's author, literally.

    ``repos`` has one row per repository and owner; the join is left to the optimizer because that
    table grows with the number of owners.
    """
    wanted = repos.where(F.col("author").isNotNull()).select("owner", F.col("root").alias("repo_root"), F.col("author").alias("wanted"))
    return commits.join(wanted, ["owner", "repo_root"]).where(F.contains("author", "wanted")).drop("wanted")
