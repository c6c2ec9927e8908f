"""A repository's history as it grows: new commits are appended to tables, each once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrykit.sources import repository


def follow_history(spark: SparkSession, root: str, path: str, checkpoint: str, repo_id: int = 1, **trigger: object) -> StreamingQuery:
    """Starts a query that writes the commits of ``root`` and their changes below ``path`` (``commits`` and ``file_changes``, a folder a batch) as they come.

    A batch that is done again after a crash replaces its own folders, so commits are there once; forced pushes bring what is new
    and take nothing away. ``trigger`` is that of the stream; all there is, and then the end, unless told otherwise.
    """
    spark.dataSource.register(repository.GitLog)
    log = spark.readStream.format("git_log").option("path", root).option("tips", f"{path.removeprefix('file://')}.tips").load()

    def write(lines: DataFrame, batch: int) -> None:
        lines = lines.persist()
        commits, changes = repository.parse_log(lines, repo_id)
        commits.write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")
        changes.write.mode("overwrite").parquet(f"{path}/file_changes/batch={batch}")
        lines.unpersist()

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


_SUMMARY = "email string, active_days long, commits long, longest_start string, longest_days long, current_start string, current_days long"


def _join_runs(firsts: np.ndarray, lasts: np.ndarray, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of days with more days in them: sorted, apart by a day at least."""
    first, last = np.concatenate([firsts, days]), np.concatenate([lasts, days])
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    begins = np.concatenate(([True], first[1:] > last[:-1] + 1))
    ends = np.append(np.flatnonzero(begins)[1:] - 1, len(first) - 1)
    return first[begins], last[ends]


def _summarise(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    firsts, lasts, commits = (np.array(state.get[0], dtype=np.int64), np.array(state.get[1], dtype=np.int64), state.get[2]) if state.exists else (np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    for batch in batches:
        firsts, lasts = _join_runs(firsts, lasts, np.unique(batch["day"].to_numpy(dtype=np.int64)))
        commits += len(batch)
    state.update((firsts.tolist(), lasts.tolist(), commits))
    length = lasts - firsts + 1
    best = int(np.argmax(length))  # the earliest of equals
    text = [str(np.datetime64(int(x), "D")) for x in (firsts[best], firsts[-1])]
    yield pd.DataFrame({"email": [key[0]], "active_days": [int(length.sum())], "commits": [commits], "longest_start": text[:1], "longest_days": [int(length[best])], "current_start": text[1:], "current_days": [int(length[-1])]})


def streak_summaries(commits: DataFrame) -> DataFrame:
    """``history.streak_summary`` of a stream (``email``, ``date``), an extension: a new row for each contributor whose commits come, in update mode.

    The state of a contributor is the list of runs of active days; a day that comes late, however late, joins the runs it lies beside. So the last row of each contributor is
    what the batch says, in any order of arrival. There is no watermark, and the state grows by the gaps between runs alone. Commits without a date count for nothing.
    """
    days = commits.where("date IS NOT NULL").select("email", F.unix_date(F.to_date("date")).alias("day"))
    return days.groupBy("email").applyInPandasWithState(_summarise, _SUMMARY, "firsts array<long>, lasts array<long>, commits long", "update", GroupStateTimeout.NoTimeout)
