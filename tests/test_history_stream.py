"""Histories that grow: commits come once, streaks are those of the batch."""

import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.operators import history
from quarrykit.streaming.history import _join_runs, follow_history, streak_summaries
from tests.test_operators import _git


def _commit(root, name, when):
    (root / name).write_text(f"{name}\n")
    _git(root, "add", ".")
    _git(root, "commit", "-m", name, when=when)


def _heads(root):
    return subprocess.run(["git", "-C", str(root), "log", "--all", "--reflog", "--pretty=%s"], capture_output=True, text=True, check=True).stdout.split()


def test_each_commit_comes_once(spark, tmp_path):
    root, out, point = tmp_path / "repo", f"file://{tmp_path}/out", f"file://{tmp_path}/point"
    root.mkdir()

    def run():
        follow_history(spark, str(root), out, point).awaitTermination(120)
        return sorted(r.message for r in spark.read.parquet(f"{out}/commits").collect())

    _git(root, "init")
    _commit(root, "a", "2024-02-01T10:00:00")
    _commit(root, "b", "2024-02-02T10:00:00")
    assert run() == ["a", "b"]
    _commit(root, "c", "2024-02-03T10:00:00")
    # a forced push: c leaves the branch, d comes
    _git(root, "branch", "old")
    assert run() == ["a", "b", "c"]
    _git(root, "reset", "--hard", "HEAD~1")
    _git(root, "branch", "-D", "old")
    _commit(root, "d", "2024-02-04T10:00:00")
    assert run() == ["a", "b", "c", "d"]
    # and another one brings c back, beside an older merge
    _git(root, "merge", "-m", "m", "HEAD@{2}", when="2024-02-05T10:00:00")
    assert run() == ["a", "b", "c", "d", "m"] == sorted(set(_heads(root)))
    assert run() == ["a", "b", "c", "d", "m"]
    changes = spark.read.parquet(f"{out}/file_changes")
    assert sorted((r.path, r.added) for r in changes.collect()) == [("a", 1), ("b", 1), ("c", 1), ("d", 1)]


@pytest.mark.parametrize("seed", range(20))
def test_runs_join_as_in_a_set_of_days(seed):
    draw = random.Random(seed)
    firsts, lasts, known = np.zeros(0, np.int64), np.zeros(0, np.int64), set()
    for _ in range(draw.randrange(1, 8)):
        days = {draw.randrange(40) for _ in range(draw.randrange(1, 9))}
        known |= days
        firsts, lasts = _join_runs(firsts, lasts, np.array(sorted(days)))
        starts = [d for d in sorted(known) if d - 1 not in known]
        assert firsts.tolist() == starts and lasts.tolist() == [d for d in sorted(known) if d + 1 not in known]


def test_streaks_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    draw = random.Random(5)
    rows = [(f"p{draw.randrange(6)}", f"2024-{draw.randrange(1, 4):02d}-{draw.randrange(1, 28):02d} {draw.randrange(24):02d}:00:00") for _ in range(300)]
    schema = "email string, date string"
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("date", F.to_timestamp("date"))
    query = streak_summaries(stream).writeStream.outputMode("update").format("memory").queryName("summaries").option("checkpointLocation", f"{tmp_path}/point").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.table("summaries").collect():
        if r.email not in last or r.commits > last[r.email].commits:
            last[r.email] = r
    batch = history.streak_summary(spark.createDataFrame(rows, schema).withColumn("date", F.to_timestamp("date")))
    assert {r.email: tuple(r) for r in batch.collect()} == {e: tuple(r) for e, r in last.items()}
