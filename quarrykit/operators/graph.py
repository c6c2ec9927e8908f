"""Import graphs: resolution, folders, cycles, reachability and what nothing uses.

``edges``: ``from_file``, ``to_file``, ``kind``, ``resolved``. ``files``: ``path``, ``language`` and more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.digraph import layers, reachable, strong_components
from quarrykit.functions.imports import ENTRY_POINTS, extract_imports
from quarrykit.functions.paths import base_name, folder_of
from quarrykit.iterate import stored


def resolve_first(specs: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each row's ``candidates`` that is a path of ``paths``, as ``to_file``; null if none is.

    ``keys`` name a row of ``specs``. Candidates keep their rank through the join; the smallest rank wins.
    """
    tries = specs.select(*keys, F.posexplode("candidates").alias("rank", "path"))
    found = tries.join(paths.select("path").distinct(), "path").groupBy(*keys).agg(F.min_by("path", "rank").alias("to_file"))
    return specs.join(found, keys, "left")


def go_module(files: DataFrame) -> DataFrame:
    """The module name in ``go.mod`` at the top, one row a repository."""
    text = F.col("content").cast("string")
    name = F.trim(F.regexp_extract(text, r"(?md)^[ \t]*module (.*)$", 1))
    return files.where("path = 'go.mod'").select("repo_id", name.alias("module"))


def import_edges(files: DataFrame) -> DataFrame:
    """Import edges of ``files`` (``repo_id``, ``path``, ``language``, ``content``) inside each repository.

    A Go import of the module's own prefix leads to a folder, found or not; the module itself is ``.``. Imports that lead
    outside are left out, repeats stay.
    """
    specs = stored(extract_imports(files), "specs")
    keys = ["repo_id", "from_file", "ordinal"]
    others = specs.where("language <> 'Go'")
    paths = files.select("repo_id", "path").distinct()
    tries = others.select(*keys, F.posexplode("candidates").alias("rank", "path"))
    found = tries.join(paths, ["repo_id", "path"]).groupBy(*keys).agg(F.min_by("path", "rank").alias("to_file"))
    plain = found.join(others.select(*keys, "language"), keys).select("repo_id", "from_file", "to_file", F.lower("language").alias("kind"), F.lit(True).alias("resolved"))
    folders = files.select("repo_id", folder_of(F.col("path")).alias("to_file")).where("to_file <> ''").distinct().withColumn("there", F.lit(True))
    go = specs.where("language = 'Go'").join(go_module(files), "repo_id").where("module <> '' AND startswith(spec, module)")
    inner = F.regexp_replace(F.substr("spec", F.length("module") + 1), r"^/+|/+$", "")
    go = go.withColumn("to_file", F.when(inner == "", ".").otherwise(inner)).join(folders, ["repo_id", "to_file"], "left")
    go = go.select("repo_id", "from_file", "to_file", F.lit("go").alias("kind"), (F.coalesce("there", F.lit(False)) | (F.col("to_file") == ".")).alias("resolved"))
    return plain.unionByName(go)


def folder_graph(edges: DataFrame, folders: DataFrame) -> DataFrame:
    """Edges between folders (``source``, ``target``), repeats kept, without edges inside one. A target that is a folder stands for itself."""
    known = edges.join(folders.select(F.col("folder").alias("to_file"), F.lit(True).alias("is_folder")).distinct(), "to_file", "left")
    target = F.when(F.col("is_folder"), F.col("to_file")).otherwise(folder_of(F.col("to_file")))
    return known.select(folder_of(F.col("from_file")).alias("source"), target.alias("target")).where("source <> target")


def entry_points(files: DataFrame) -> DataFrame:
    return files.where(base_name(F.col("path")).isin(*ENTRY_POINTS)).select("path")


def dead_files(files: DataFrame, edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Files that imports don't reach from entry points; a folder that is reached leads to its files."""
    entries = entry_points(files) if entries is None else entries
    steps = edges.select(F.col("from_file").alias("source"), F.col("to_file").alias("target"))
    inside = files.select(folder_of(F.col("path")).alias("source"), F.col("path").alias("target")).where("source <> ''")
    steps = stored(steps.unionByName(inside).distinct(), "steps")
    seen = reachable(steps, entries.select(F.col("path").alias("node")))
    return files.select("path").join(seen.withColumnRenamed("node", "path"), "path", "left_anti")


def unused_folders(folders: DataFrame, graph: DataFrame, entries: DataFrame) -> DataFrame:
    """Folders that no other folder imports and no entry point lies in."""
    used = graph.select(F.col("target").alias("folder")).unionByName(entries.select(folder_of(F.col("path")).alias("folder"))).distinct()
    return folders.select("folder").where("folder <> ''").distinct().join(used, "folder", "left_anti")


def cycles(graph: DataFrame) -> DataFrame:
    """Folders that import each other in a circle: ``component``, ``node`` (each of its folders) and ``size``."""
    found = stored(strong_components(graph.select("source", "target")), "cycles")
    return found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component")


def import_layers(edges: DataFrame) -> DataFrame:
    """The longest chain of resolved imports from each file (``node``, ``layer``); files that import each other in a circle lie in one layer."""
    return layers(edges.where("resolved").select(F.col("from_file").alias("source"), F.col("to_file").alias("target")))


def cycle_lists(found: DataFrame) -> DataFrame:
    """``cycles`` as one row each, with sorted ``members``, smallest first; for reports of circles that a person reads."""
    return found.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"), F.first("size").alias("size")).orderBy("size", "component")


def unresolved(edges: DataFrame) -> DataFrame:
    return edges.where("NOT resolved")


def report(files: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All parts of an architecture report of one repository, from its files and stored edges."""
    folders = files.select(folder_of(F.col("path")).alias("folder")).where("folder <> ''").distinct()
    graph, entries = folder_graph(edges, folders), entry_points(files)
    return {
        "edges": edges, "folders": folders.orderBy("folder"), "entry_points": entries.orderBy("path"), "cycles": cycle_lists(cycles(graph)),
        "dead_files": dead_files(files, edges, entries).orderBy("path"), "unused_folders": unused_folders(folders, graph, entries).orderBy("folder"), "unresolved": unresolved(edges),
    }


def nodes(edges: DataFrame) -> DataFrame:
    """Files at either end of resolved edges."""
    known = edges.where("resolved")
    return known.select(F.col("from_file").alias("node")).union(known.select("to_file")).distinct()
