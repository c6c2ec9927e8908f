"""Stored intermediate tables, and connected components on them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or on a local master a temporary one where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    set_before = context.getCheckpointDir()
    if set_before:
        return set_before
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-quarrykit-")
    context.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quarrykit/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read from there.

    It cuts the lineage: a lost executor costs a reread, not the work before it.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more; what was made of them must be stored itself."""
    for table in tables:
        delete_path(table.sparkSession, table._stored_at)
        _written.pop(table._stored_at, None)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def find_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index for each of ``n`` nodes, linked by the pairs ``a[i] - b[i]``."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replaces the edges of each batch by as few edges that join the same nodes, each to its smallest."""
    for batch in batches:
        ids, at = np.unique(np.concatenate([batch.a.to_numpy(), batch.b.to_numpy()]), return_inverse=True)
        half = len(batch)
        root = find_roots(at[:half], at[half:], len(ids))
        moved = root != np.arange(len(ids))
        yield pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b`` longs): one row (``node``, ``root``) per linked node.

    ``root`` is the smallest id that can be reached. Rounds of two steps on star-shaped edges: every node
    hands its larger neighbours to its smallest one, then every node links its smaller neighbours. Each
    round halves the depth at least, so rounds grow with the logarithm of a chain's length. Minima are
    taken by partial aggregation, and joins read written tables on both sides, so that a node with very
    many neighbours is split by adaptive execution. Self links and nulls are ignored.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    edges = table = stored(edges.mapInPandas(_forest, "a long, b long"), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stored(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "lowest")
        # larger neighbours of a node move to its smallest neighbour
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b")
        large = stored(large.distinct(), "large")
        # smaller neighbours of a node, and the node, move to the smallest
        least = stored(large.groupBy("a").agg(F.min("b").alias("low")), "least")
        moved = large.join(least, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"), F.lit(True).alias("moved"))
        kept = least.select("a", F.col("low").alias("b"), F.lit(False).alias("moved"))
        found = stored(kept.unionByName(moved).groupBy("a", "b").agg(F.max("moved").alias("moved")), "edges")
        released(table, lowest, large, least)
        table = found
        edges = found.select("a", "b")
        if found.where("moved").isEmpty():
            # one edge a node is left; done once no node is both a member and a root
            chained = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            if chained.isEmpty():
                break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
