"""Commit history: activity, streaks, contributors, files and ownership.

``commits``: ``hash``, ``author``, ``email``, ``message``, ``date``, ``insertions``, ``deletions`` and more. ``changes``: a row per file of a commit (``hash``, ``path``, ``added``, ``deleted``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.paths import day_of
from quarrykit.ordering import Ordered, ordered


def _long(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("long")


def heatmap_daily(commits: DataFrame) -> DataFrame:
    """Commits per active day."""
    return commits.groupBy(day_of(F.col("date")).alias("day")).agg(F.count("*").alias("commits"))


def heatmap_hourly(commits: DataFrame) -> DataFrame:
    """Commits per weekday (0: Sunday) and hour, all 168 of them."""
    counts = commits.groupBy((F.dayofweek("date") - 1).alias("weekday"), F.hour("date").alias("hour")).agg(F.count("*").alias("n"))
    spark = commits.sparkSession
    grid = spark.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(F.broadcast(counts), ["weekday", "hour"], "left").select("weekday", "hour", _long(F.col("n")).alias("commits"))  # 168 counts at most


def heatmap_range(commits: DataFrame) -> DataFrame:
    return commits.agg(F.count("*").alias("total"), day_of(F.min("date")).alias("first_day"), day_of(F.max("date")).alias("last_day"))


def streaks(commits: DataFrame) -> DataFrame:
    """Runs of consecutive active days of each contributor. Days are made distinct before the window, which so sorts days, not commits."""
    days = commits.select("email", F.to_date("date").alias("day")).distinct()
    rank = F.row_number().over(Window.partitionBy("email").orderBy("day"))
    islands = days.withColumn("island", F.date_sub("day", rank))
    runs = islands.groupBy("email", "island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days"))
    return runs.select("email", F.date_format("first", "yyyy-MM-dd").alias("start_day"), F.date_format("last", "yyyy-MM-dd").alias("end_day"), "days")


def streak_summary(commits: DataFrame) -> DataFrame:
    """Longest streak (the earliest of equals) and latest streak of each contributor, active days and commits."""
    runs = streaks(commits).groupBy("email").agg(
        F.max_by(F.struct("start_day", "days"), F.struct("days", -F.unix_date(F.to_date("start_day")))).alias("longest"),
        F.max_by(F.struct("start_day", "days"), "start_day").alias("current"),
        F.sum("days").alias("active_days"),
    )
    totals = commits.groupBy("email").agg(F.count("*").alias("commits"))
    return runs.join(totals, "email").select(
        "email", "active_days", "commits",
        F.col("longest.start_day").alias("longest_start"), F.col("longest.days").alias("longest_days"),
        F.col("current.start_day").alias("current_start"), F.col("current.days").alias("current_days"),
    )


def streak_leaders(commits: DataFrame) -> DataFrame:
    """The summary of streaks, longest first; equals by e-mail."""
    return streak_summary(commits).orderBy(F.desc("longest_days"), "email")


def contributors(commits: DataFrame) -> DataFrame:
    """Commits, lines, first and last time of each contributor, known by e-mail or else by name; the newest commit names them."""
    key = F.coalesce(F.nullif(F.col("email"), F.lit("")), F.col("author"))
    return commits.groupBy(key.alias("email")).agg(
        F.max_by("author", F.struct("date", "hash")).alias("name"), F.count("*").alias("commits"),
        F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.min("date").alias("first_commit_at"), F.max("date").alias("last_commit_at"),
    )


def leaderboard(commits: DataFrame) -> DataFrame:
    return contributors(commits).orderBy(F.desc("commits"), "email")


def top_contributors(commits: DataFrame, n: int = 10) -> DataFrame:
    """The first of the leaderboard; who has no name goes by e-mail."""
    return leaderboard(commits).limit(n).select(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("email")).alias("label"), "commits")


def commit_feed(commits: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; 50 a page unless told otherwise, 500 at most."""
    return commits.orderBy(F.desc("date"), F.desc("hash")).offset(max(0, offset)).limit(min(500, limit) if limit > 0 else 50)


def deep_feed(commits: DataFrame) -> Ordered:
    """The feed written in its order once, for pages at any depth."""
    return ordered(commits, F.desc("date"), F.desc("hash"))


def largest_commits(commits: DataFrame, limit: int = 20) -> DataFrame:
    changed = (F.col("insertions") + F.col("deletions")).alias("changed")
    return commits.select("*", changed).orderBy(F.desc("changed"), "hash").limit(min(200, limit) if limit > 0 else 20)


def commit_rollup(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Files and lines of each commit from its changes; zeros for commits without any."""
    sums = changes.groupBy("hash").agg(F.count("*").alias("files_changed"), F.sum("added").alias("insertions"), F.sum("deleted").alias("deletions"))
    known = commits.drop("files_changed", "insertions", "deletions").join(sums, "hash", "left")
    return known.withColumns({x: _long(F.col(x)) for x in ("files_changed", "insertions", "deletions")})


def file_history(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits, first and last time and last author of each path. Both sides of the join meet on the commit, once."""
    touched = changes.select("hash", "path").join(commits.select("hash", "author", "date"), "hash")
    return touched.groupBy("path").agg(
        F.count("*").alias("commits"), F.min("date").alias("first_commit_at"), F.max("date").alias("last_commit_at"),
        F.max_by("author", F.struct("date", "hash")).alias("author"),
    )


def attribute_files(files: DataFrame, history: DataFrame) -> DataFrame:
    """Files with their history; none: no commits, no author."""
    known = files.drop("commits", "author", "first_commit_at", "last_commit_at").join(history, "path", "left")
    return known.withColumns({"commits": _long(F.col("commits")), "author": F.coalesce("author", F.lit(""))})


def ownership(files: DataFrame) -> DataFrame:
    """Files last changed by each author, and their share of all that have an author."""
    counts = files.where(F.coalesce("author", F.lit("")) != "").groupBy("author").agg(F.count("*").alias("files"))
    total = counts.agg(F.sum("files").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("author", "files", (F.col("files") / F.col("all")).alias("share"))  # one row


def heat_levels(daily: DataFrame) -> DataFrame:
    """Days with levels 0 to 3 by thirds of the busiest day, and rows of seven active days each."""
    peak = daily.agg(F.max("commits").alias("peak"))
    part = F.col("commits") / F.col("peak")
    level = F.when(F.col("commits") == 0, 0).when(part > 0.66, 3).when(part > 0.33, 2).otherwise(1)
    week = F.floor((F.row_number().over(Window.orderBy("day")) - 1) / 7)  # days, so a few thousand rows
    return daily.crossJoin(F.broadcast(peak)).select("day", "commits", level.alias("level"), week.cast("long").alias("week"))
