"""Directed graphs: what can be reached, strong components, and layers by longest paths.

Edges are rows (``source``, ``target``) of any type that has an order. Loops run over stored tables while a graph is large; what has
at most ``LOCAL`` edges is solved at once in a task, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.iterate import released, stored

#: Edges that one task takes at most: some 100 MB with names as strings.
LOCAL = 500_000
#: Hops of a search before shortcuts are made.
PLAIN = 6


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _coded(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, pd.Index]:
    """Edges by the ranks of their nodes among all names in order."""
    names = pd.Index(pd.concat([frame["source"], frame["target"].dropna()]).unique()).sort_values()
    return names.get_indexer(frame["source"]), names.get_indexer(frame["target"]), names


def _neighbours(a: np.ndarray, b: np.ndarray, n: int) -> list[list[int]]:
    order = np.argsort(a, kind="stable")
    return [x.tolist() for x in np.split(b[order], np.searchsorted(a[order], np.arange(1, n)))] if n else []


def _reach_once(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes that rows without a target reach by the others, by ``way``."""
    found = []
    for way, own in frame.groupby("way"):
        a, b, names = _coded(own)
        edge = b >= 0
        after = _neighbours(a[edge], b[edge], len(names))
        seen = np.zeros(len(names), dtype=bool)
        todo = np.unique(a[~edge]).tolist()
        seen[todo] = True
        while todo:
            for k in after[todo.pop()]:
                if not seen[k]:
                    seen[k] = True
                    todo.append(k)
        found.append(pd.DataFrame({"way": way, "node": names[seen]}))
    return pd.concat(found) if found else pd.DataFrame({"way": [], "node": []})


def _strong_once(frame: pd.DataFrame) -> pd.DataFrame:
    """Strong components of two nodes and more, each by its smallest node: one depth-first search with a stack of its own."""
    a, b, names = _coded(frame)
    n = len(names)
    after = _neighbours(a, b, n)
    index, low, root, on, path, clock = [-1] * n, [0] * n, [-1] * n, [False] * n, [], 0
    for first in range(n):
        if index[first] >= 0:
            continue
        calls = [(first, iter(after[first]))]
        index[first] = low[first] = clock
        clock += 1
        path.append(first)
        on[first] = True
        while calls:
            node, rest = calls[-1]
            for k in rest:
                if index[k] < 0:
                    index[k] = low[k] = clock
                    clock += 1
                    path.append(k)
                    on[k] = True
                    calls.append((k, iter(after[k])))
                    break
                if on[k]:
                    low[node] = min(low[node], index[k])
            else:
                calls.pop()
                if calls:
                    low[calls[-1][0]] = min(low[calls[-1][0]], low[node])
                if low[node] == index[node]:
                    at = len(path) - 1
                    while path[at] != node:
                        at -= 1
                    own = path[at:]
                    del path[at:]
                    for k in own:
                        on[k] = False
                        root[k] = min(own) if len(own) > 1 else -1
    taken = np.array(root, dtype=np.int64)
    return pd.DataFrame({"node": names[taken >= 0], "component": names[taken[taken >= 0]]})


def _peel_once(base: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def peel(frame: pd.DataFrame) -> pd.DataFrame:
        """Longest paths from each node of a graph without cycles, plus ``base``."""
        a, b, names = _coded(frame)
        n = len(names)
        before, left = _neighbours(b, a, n), np.bincount(a, minlength=n).tolist()
        layer = [base] * n
        todo = [k for k in range(n) if left[k] == 0]
        while todo:
            k = todo.pop()
            for p in before[k]:
                layer[p] = max(layer[p], layer[k] + 1)
                left[p] -= 1
                if left[p] == 0:
                    todo.append(p)
        return pd.DataFrame({"node": names, "layer": layer})

    return peel


def _shortcuts(hops: DataFrame) -> list[DataFrame]:
    """Stored paths of 2, 4, 8 … hops, one from each node: every node points at one target, and pointers are followed twice as far each time.

    Targets that lead on are preferred; which of them is drawn by a hash.
    """
    onward = hops.select("way", F.col("source").alias("target")).distinct()
    last = stored(hops.join(onward, ["way", "target"], "left_semi").groupBy("way", "source").agg(F.min_by("target", F.xxhash64("source", "target")).alias("target")), "jump0")
    levels, n = [], last.count()
    for _ in range(max(n, 1).bit_length()):
        last = stored(last.join(last.select("way", F.col("source").alias("target"), F.col("target").alias("far")), ["way", "target"]).select("way", "source", F.col("far").alias("target")), "jump")
        if last.isEmpty():
            break
        levels.append(last)
    return levels


def _search(hops: DataFrame, n: int, seeds: DataFrame, local: int) -> DataFrame:
    """Nodes (``way``, ``node``; stored) that hops (``way``, ``source``, ``target``; stored, ``n`` of them) reach from ``seeds`` (``way``, ``node``), seeds included."""
    seeds = stored(seeds.distinct(), "seeds")
    node_type = hops.schema["source"].dataType.simpleString()
    if n <= local:
        starts = seeds.join(hops.select("way", F.col("source").alias("node")).distinct(), ["way", "node"], "left_semi")
        rows = hops.unionByName(starts.select("way", F.col("node").alias("source")), allowMissingColumns=True)
        near = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_reach_once, f"way int, node {node_type}")
        return stored(near.unionByName(seeds).distinct(), "reached")
    found, ways, rounds = [seeds], hops, 0
    while not found[-1].isEmpty():
        rounds += 1
        if rounds == PLAIN + 1:
            ways = _union([hops, *_shortcuts(hops)])
        step = ways.join(found[-1].withColumnRenamed("node", "source"), ["way", "source"]).select("way", F.col("target").alias("node")).distinct()
        for part in found:
            step = step.join(part, ["way", "node"], "left_anti")
        found.append(stored(step, "reached"))
        if len(found) > 8:  # merged now and then, so that a round looks at few tables
            merged = stored(_union(found[:-1]), "reached")
            released(*found[:-1])
            found = [merged, found[-1]]
    return _union(found)


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()


def reachable(edges: DataFrame, seeds: DataFrame, local: int = LOCAL) -> DataFrame:
    """Nodes (``node``) that paths of ``edges`` (``source``, ``target``) reach from ``seeds`` (``node``), seeds included. Nulls are no nodes.

    A search by hops, each a join of the newly found nodes with the edges. If it isn't done after some hops, each node also gets shortcuts of 2,
    4, 8 … hops along one of the paths from it, and the search goes on with these: a chain takes rounds in the logarithm of its length. Where paths
    branch at every node, shortcuts follow few of them, and rounds may grow with the length.
    """
    hops = stored(_pairs(edges).select(F.lit(0).alias("way"), "source", "target"), "hops")
    return _search(hops, hops.count(), seeds.where("node IS NOT NULL").select(F.lit(0).alias("way"), "node"), local).select("node")


def strong_components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """Strongly connected components of two nodes and more: ``node``, ``component`` (its smallest node).

    Forward and backward search from a pivot, drawn by a hash: what both find is a component, and components never cross the
    borders between what only one of them or neither finds. These parts go on side by side, each with a pivot of its own, so rounds are about the logarithm of what
    a pivot halves; parts of at most ``local`` edges are solved in tasks.
    """
    pairs = _pairs(edges).where("source <> target")
    node_type = pairs.schema["source"].dataType.simpleString()
    left, done, salt = stored(pairs.withColumn("part", F.lit(0).cast("long")), "parts"), [], 0
    while True:
        sizes = left.groupBy("part").agg(F.count("*").alias("n"))
        small, n = sizes.where(F.col("n") <= local).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        if n:
            # parts share a task as long as they are small together
            bins = ceil(2 * small / max(local, 1))
            chosen = left.join(sizes.where(F.col("n") <= local).select("part"), "part").withColumn("bin", F.pmod(F.xxhash64("part", F.lit(salt)), F.lit(bins)))
            done.append(stored(chosen.groupBy("bin").applyInPandas(_strong_once, f"node {node_type}, component {node_type}"), "found"))
            left = stored(left.join(sizes.where(F.col("n") > local).select("part"), "part", "left_semi"), "parts")
        count = left.count()
        if not count:
            break
        salt += 1
        pivots = left.groupBy("part").agg(F.min_by("source", F.xxhash64("source", F.lit(salt))).alias("node"))
        pivots = stored(pivots, "pivots")
        hops = left.select(F.lit(0).alias("way"), "source", "target").unionByName(left.select(F.lit(1).alias("way"), F.col("target").alias("source"), F.col("source").alias("target")))
        seeds = pivots.select(F.lit(0).alias("way"), "node").unionByName(pivots.select(F.lit(1).alias("way"), "node"))
        seen = _search(stored(hops, "hops"), 2 * count, seeds, local)
        marks = stored(seen.groupBy("node").agg(F.sum(F.col("way") + 1).alias("mark")), "marks")
        marked = left
        for end in ("source", "target"):
            marked = marked.join(marks.select(F.col("node").alias(end), F.col("mark").alias(f"{end}_mark")), end, "left").fillna(0, [f"{end}_mark"])
        marked = stored(marked, "marked")
        ring = marked.where("source_mark = 3 AND target_mark = 3")
        lowest = ring.groupBy("part").agg(F.min("source").alias("component"))
        done.append(stored(ring.select("part", F.col("source").alias("node")).distinct().join(lowest, "part").select("node", "component"), "found"))
        rest = marked.where("source_mark = target_mark AND source_mark < 3")
        rest = stored(rest.select("source", "target", F.xxhash64("part", "source_mark").alias("part")), "parts")
        released(left, pivots, marks, marked)
        left = rest
    return _union(done) if done else edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)


def layers(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """The longest path from each node (``node``, ``layer``): nodes that lead nowhere are layer 0, and every node lies above all that it leads to.

    Nodes of a strong component lie in one layer, as one. Nodes without a way on are peeled off, layer after layer, until what is
    left fits in a task; before that there are as many rounds as layers.
    """
    pairs = stored(_pairs(edges), "pairs")
    strong = stored(strong_components(pairs, local), "strong")
    named = pairs
    for end in ("source", "target"):
        named = named.join(strong.select(F.col("node").alias(end), F.col("component").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    left = stored(named.select("source", "target").where("source <> target").distinct(), "left")
    nodes = pairs.select(F.col("source").alias("node")).unionByName(pairs.select(F.col("target").alias("node"))).distinct()
    kind = left.schema["source"].dataType.simpleString()
    found, at = [], 0
    while True:
        n = left.count()
        if n <= local:
            found.append(left.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_peel_once(at), f"node {kind}, layer long"))
            break
        ends = stored(left.select(F.col("target").alias("node")).distinct().join(left.select(F.col("source").alias("node")).distinct(), "node", "left_anti"), "ends")
        at += 1
        gone = left.join(ends.select(F.col("node").alias("target")), "target", "left_semi")
        found.append(stored(gone.select(F.col("source").alias("node"), F.lit(at).cast("long").alias("layer")).distinct(), "layer"))
        rest = stored(left.join(ends.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target"), "left")
        released(left, ends)
        left = rest
    tops = _union(found).groupBy("node").agg(F.max("layer").alias("layer")).withColumnRenamed("node", "component")
    known = nodes.join(strong, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return known.join(tops, "component", "left").select("node", F.coalesce("layer", F.lit(0)).cast("long").alias("layer"))
