"""A whole scan of a repository: source tree and history in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.iterate import stored
from quarrykit.operators import duplicates, graph, history, search
from quarrykit.settings import Settings
from quarrykit.sources import manifests, repository


def scan(spark: SparkSession, root: str, repo_id: int = 1, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Every table of a repository. The tree is read once and stored; a folder without Git has no history."""
    settings = (settings or Settings()).validate()
    for source in (repository.RepositoryFiles, repository.GitLog):
        spark.dataSource.register(source)
    raw = spark.read.format("repository_files").option("path", root).option("repoId", str(repo_id)).option("settings", settings.to_json()).load()
    files = stored(repository.measure_files(raw), "files").withColumn("file_id", F.xxhash64("path"))
    log = stored(spark.read.format("git_log").option("path", root).load(), "log")
    commits, changes = repository.parse_log(log, repo_id)
    commits, changes = stored(commits, "commits"), stored(changes, "changes")
    edges = stored(graph.import_edges(files), "edges")
    runs = stored(duplicates.shingles(duplicates.code_lines(files.where("language <> '' AND content IS NOT NULL")), settings.dupMinLines), "runs")
    pairs = stored(duplicates.similar_pairs(runs, settings.dupMinSimilarity), "pairs")
    owned = history.attribute_files(files.drop("content"), history.file_history(commits, changes))
    repo = F.lit(repo_id).cast("long").alias("repo_id")
    paths = files.select("file_id", "path")
    return {
        "repository": repository.repository(spark, root, repo_id),
        "files": owned, "commits": commits, "file_changes": changes,
        "branches": repository.refs(spark, root, "heads", repo_id), "tags": repository.refs(spark, root, "tags", repo_id),
        "contributors": history.contributors(commits).select(repo, "*"),
        "dependencies": manifests.dependencies(files), "import_edges": edges,
        "duplicate_groups": duplicates.duplicate_groups(runs, pairs, settings.dupMinLines).select(repo, "*"),
        "duplicate_blocks": duplicates.duplicate_blocks(runs, pairs, settings.dupMinLines).join(paths, "file_id").select(repo, "group_id", "path", "start_line", "end_line"),
        "content_index": search.build_index(files.where("content IS NOT NULL")).select(repo, "*"),
    }
