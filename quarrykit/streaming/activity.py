"""Commit activity as streams, an extension: the batch results on what has arrived, late rows dropped behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stream(commits: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Commits per day of a stream with a ``date``."""
    counted = commits.withWatermark("date", lateness).groupBy(F.window("date", "1 day")).agg(F.count("*").alias("commits"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "commits")


def streak_stream(commits: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Runs of activity of each ``email`` whose days follow each other: a session of day starts that a gap of over a day ends."""
    days = commits.withWatermark("date", lateness).withColumn("day", F.date_trunc("day", "date"))
    runs = days.groupBy(F.session_window("day", "25 hours"), "email").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return runs.select("email", F.date_format("first", "yyyy-MM-dd").alias("start_day"), F.date_format("last", "yyyy-MM-dd").alias("end_day"), (F.datediff("last", "first") + 1).cast("long").alias("days"))
