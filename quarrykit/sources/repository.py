"""Source trees and Git history as Spark data sources.

``spark.dataSource.register(RepositoryFiles)``, then ``spark.read.format("repository_files").option("path", root).load()``. The driver lists, tasks read.
A tree must be at the same path on every worker, as with any file source.
"""

from __future__ import annotations

import fnmatch
import os
import subprocess
import tempfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarrykit.functions.code import code_metrics, line_counts
from quarrykit.functions.languages import language_of
from quarrykit.functions.paths import base_name, extension_of, folder_of
from quarrykit.iterate import delete_path
from quarrykit.schemas import COMMITS, FILE_CHANGES, RAW_FILES
from quarrykit.settings import Settings

FILES_PER_PARTITION = 256
RECORD, FIELD = "\x1e", "\x1f"
_FORMAT = RECORD + FIELD.join(("%H", "%an", "%ae", "%at", "%P", "%s"))


def list_files(root: str, settings: Settings) -> Iterator[tuple[str, int]]:
    """Relative paths and sizes of a tree's files, dotfiles too. Folders that are ignored or too deep aren't entered;
    what can't be read is left out. Symbolic links aren't followed."""
    ignored = {x.lower() for x in settings.ignoreFolders}
    endings = {x.lower() for x in settings.ignoreExtensions}
    for folder, below, names in os.walk(root):
        inner = os.path.relpath(folder, root).replace(os.sep, "/")
        depth = 0 if inner == "." else inner.count("/") + 1
        deeper = not settings.maxFileDepth or depth + 1 < settings.maxFileDepth
        below[:] = sorted(d for d in below if deeper and d.lower() not in ignored)
        for name in sorted(names):
            full = os.path.join(folder, name)
            dot = name.rfind(".")
            if dot >= 0 and name[dot:].lower() in endings or os.path.islink(full):
                continue
            try:
                size = os.stat(full).st_size
            except OSError:
                continue
            if size <= settings.maxFileSize:
                yield (name if inner == "." else f"{inner}/{name}"), size


class _Slice(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.repo = int(options.get("repoId", 1))
        self.settings = Settings.from_json(options.get("settings", ""))

    def partitions(self) -> list[InputPartition]:
        files = list(list_files(self.root, self.settings))
        return [_Slice(files[k : k + FILES_PER_PARTITION]) for k in range(0, len(files), FILES_PER_PARTITION)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for path, size in partition.files if partition else ():
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    content = f.read()
            except OSError:
                content = None
            yield self.repo, path, size, content


class RepositoryFiles(DataSource):
    """Files of a tree (``RAW_FILES``). Options: ``path``, ``repoId``, ``settings`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self) -> str:
        return RAW_FILES

    def reader(self, schema: object) -> DataSourceReader:
        return _FilesReader(self.options)


def git(root: str, *args: str) -> str:
    """Output of a Git command; nothing if it fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    return done.stdout if done.returncode == 0 else ""


def _rev_list(root: str, of: Iterable[str], without: Iterable[str]) -> list[str]:
    """Commits that ``of`` lead to and ``without`` don't, newest first. Hashes that Git doesn't know are ignored."""
    asked = [*of, *(f"^{x}" for x in without)]
    if not asked:
        return []
    done = subprocess.run(["git", "-C", root, "rev-list", "--date-order", "--ignore-missing", "--stdin"], input="\n".join(asked) + "\n", capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git rev-list failed in {root}: {done.stderr.strip()}")
    return done.stdout.split()


class _Commits(InputPartition):
    """Commits with the ordinals from ``first`` on."""

    def __init__(self, first: int, hashes: list[str]):
        self.first, self.hashes = first, hashes


class _LogLines:
    """Lines of slices of a log; what the batch and the stream share."""

    def __init__(self, options: dict[str, str]):
        self.root, self.size = options["path"], max(1, int(options.get("commits", "2000")))

    def slices(self, hashes: list[str]) -> list[InputPartition]:
        return [_Commits(k + 1, hashes[k : k + self.size]) for k in range(0, len(hashes), self.size)] or [_Commits(1, [])]

    def read(self, partition: _Commits) -> Iterator[tuple]:
        if not partition.hashes:
            return
        command = ["git", "-C", self.root, "log", "--no-walk=unsorted", "--stdin", "--numstat", f"--pretty=format:{_FORMAT}"]
        with tempfile.TemporaryFile() as wanted:
            wanted.write("\n".join(partition.hashes).encode())
            wanted.seek(0)
            log = subprocess.Popen(command, stdin=wanted, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
            ordinal = partition.first - 1
            for raw in log.stdout or ():
                line = raw.decode("utf-8", "replace").rstrip("\n")
                if line:
                    ordinal += line.startswith(RECORD)
                    yield ordinal, line
            if log.wait():
                raise RuntimeError(f"git log failed in {self.root}")


class _LogReader(_LogLines, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.slices(git(self.root, "rev-list", "--all", "--date-order").split())


class _LogStreamReader(_LogLines, DataSourceStreamReader):
    """An offset is every tip that was ever seen, without those that others lead to. A batch is what is reachable from its end and wasn't from its
    start, so a commit comes once, also if refs are moved back and forth."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.kept = options.get("tips")
        self.tips: set[str] = set()

    def initialOffset(self) -> dict:  # noqa: N802 - the interface's name
        return {"tips": []}

    def _known(self) -> set[str]:
        if self.kept and os.path.exists(self.kept):
            with open(self.kept) as f:
                return self.tips | set(f.read().split())
        return self.tips

    def latestOffset(self) -> dict:  # noqa: N802
        heads = set(git(self.root, "for-each-ref", "--format=%(objectname)").split()) | set(git(self.root, "rev-parse", "--verify", "-q", "HEAD").split())
        old = self._known() - heads
        # of earlier tips, only those that today's don't lead to are kept; those that Git has deleted are, too
        beyond = set(_rev_list(self.root, old, heads))
        gone = {x for x in old if not git(self.root, "cat-file", "-t", x)}
        return {"tips": sorted(heads | (old & beyond) | gone)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.tips |= set(end["tips"])
        if self.kept:
            fresh = f"{self.kept}.new"
            with open(fresh, "w") as f:
                f.write("\n".join(end["tips"]))
            os.replace(fresh, self.kept)
            self.tips = set(end["tips"])
        return self.slices(_rev_list(self.root, end["tips"], start["tips"]))


class GitLog(DataSource):
    """Lines of a repository's log on all refs (``commit``: ordinal, newest first, ``line``). The driver lists hashes alone; tasks compare the files of ``commits`` commits each. Parsing is left to Spark.

    As a stream, each batch has the commits that came since the last one, with ordinals of its own. Option ``tips`` names a file
    that keeps the tips of the batches; without it, a restarted stream knows only those of its last batch, and would read commits again that a
    forced push took away before it and another one brought back.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "commit long, line string"

    def reader(self, schema: object) -> DataSourceReader:
        return _LogReader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return _LogStreamReader(self.options)


def parse_log(log: DataFrame, repo_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """Commits and file changes of log lines. Headers need all six fields; changes of binary files have no line counts and are left out."""
    part = F.split(F.substr("line", F.lit(2)), FIELD)
    headers = log.where(F.col("line").startswith(RECORD) & (F.size(part) >= 6)).select("commit", part.alias("p"))
    heads = headers.select(
        "commit", F.col("p")[0].alias("hash"), F.col("p")[1].alias("author"), F.col("p")[2].alias("email"), F.col("p")[5].alias("message"),
        F.timestamp_seconds(F.col("p")[3].try_cast("long")).alias("date"), (F.size(F.split(F.trim(F.col("p")[4]), " +")) > 1).alias("is_merge"),
    ).where("date IS NOT NULL")
    cells = F.split("line", "\t", 3)
    rows = log.where(~F.col("line").startswith(RECORD)).select("commit", cells.alias("c")).where(F.size("c") == 3)
    rows = rows.select("commit", F.col("c")[0].try_cast("long").alias("added"), F.col("c")[1].try_cast("long").alias("deleted"), F.col("c")[2].alias("path"))
    rows = rows.where("added IS NOT NULL AND deleted IS NOT NULL").join(heads.select("commit", "hash"), "commit")
    changes = rows.select(F.lit(repo_id).cast("long").alias("repo_id"), "hash", "path", "added", "deleted")
    sums = changes.groupBy("hash").agg(F.count("*").alias("files_changed"), F.sum("added").alias("insertions"), F.sum("deleted").alias("deletions"))
    commits = heads.join(sums, "hash", "left").fillna(0, ["files_changed", "insertions", "deletions"])
    return commits.select(F.lit(repo_id).cast("long").alias("repo_id"), *_names(COMMITS)[1:]), changes.select(*_names(FILE_CHANGES))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def refs(spark: SparkSession, root: str, kind: str, repo_id: int = 1) -> DataFrame:
    """Branches (``kind`` heads) or tags; an annotated tag has its own object's hash."""
    current = git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
    rows = [line.split(FIELD) for line in git(root, "for-each-ref", f"refs/{kind}", f"--format=%(refname:short){FIELD}%(objectname)").splitlines() if line]
    if kind == "tags":
        return spark.createDataFrame([(repo_id, a, b) for a, b in rows], "repo_id long, name string, commit_hash string")
    return spark.createDataFrame([(repo_id, a, b, a == current) for a, b in rows], "repo_id long, name string, commit_hash string, is_current boolean")


def repository(spark: SparkSession, root: str, repo_id: int = 1) -> DataFrame:
    """One row of what Git says about a repository; empty texts outside one."""
    count = lambda kind: len([x for x in git(root, "for-each-ref", f"refs/{kind}", "--format=%(refname)").splitlines() if x])
    row = (repo_id, os.path.basename(os.path.abspath(root)), os.path.abspath(root), git(root, "config", "--get", "remote.origin.url").strip(), git(root, "rev-parse", "HEAD").strip(), git(root, "rev-parse", "--abbrev-ref", "HEAD").strip(), count("heads"), count("tags"), datetime.now(timezone.utc).replace(tzinfo=None))
    return spark.createDataFrame([row], "repo_id long, name string, path string, remote string, head_commit string, default_branch string, branch_count long, tag_count long, scanned_at timestamp_ntz")


def measure_files(raw: DataFrame) -> DataFrame:
    """Raw files with names, language and measures. Binary, unreadable and unknown files have rows of zeros; text stays as ``content``."""
    named = raw.select("repo_id", "path", base_name(F.col("path")).alias("name"), folder_of(F.col("path")).alias("folder"), extension_of(F.col("path")).alias("extension"), language_of(F.col("path")).alias("language"), "size", "content")
    head = F.substring("content", 1, 512)
    text = F.when(F.octet_length(head) == F.octet_length(F.replace(head.cast("string"), F.lit("\x00"), F.lit(""))), F.try_validate_utf8(F.col("content").cast("string")))
    text = F.coalesce(text, F.when(F.locate("\x00", head.cast("string")) == 0, F.make_valid_utf8(F.col("content").cast("string"))))
    read = named.withColumn("content", text)
    counted = read.withColumn("l", line_counts("content", "language")).withColumn("m", code_metrics("content", "language"))
    return counted.select("repo_id", "path", "name", "folder", "extension", "language", "size", "l.*", "m.*", "content")


def browse(path: str) -> tuple[str, str, list[str]]:
    """A folder, its parent and the folders in it that aren't hidden, by name in any case."""
    path = os.path.abspath(path)
    inside = [e.name for e in os.scandir(path) if e.is_dir() and not fnmatch.fnmatch(e.name, ".*")]
    return path, os.path.dirname(path), sorted(inside, key=str.lower)


def write_tables(tables: dict[str, DataFrame], path: str, repo_ids: list[int] | None = None) -> None:
    """Writes each table as Parquet by repository; a repository that is scanned again replaces its own rows alone.

    ``repo_ids`` are the repositories that were scanned, or else all that have a row in any table. A table that has no rows of one of
    them any more loses the old ones too.
    """
    seen = {name: {r.repo_id for r in table.select("repo_id").distinct().collect()} for name, table in tables.items()}  # a few ids
    scanned = set().union(*seen.values()) if repo_ids is None else set(repo_ids)
    for name, table in tables.items():
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{path}/{name}")
        for repo_id in sorted(scanned - seen[name]):
            delete_path(table.sparkSession, f"{path}/{name}/repo_id={repo_id}")
