"""A written inverted index that is searched in place and kept up to date file by file.

``postings/segment=N/range=R``: ``token``, ``file_id``, ``positions`` in order of token and file. Ranges are of both, so a frequent token is split.
``catalogue/segment=N``: the first and last token of each range, so that a search reads only ranges that may hold its tokens.
``changes/segment=N``: every file that the segment speaks of. Of a file that several segments speak of, the last one counts.

A segment is there once its catalogue is, which is written last; what a lost write left behind is read by no one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.iterate import delete_path, partitions, released, stored
from quarrykit.operators.search import build_index, tokens_of

_POSTINGS = "token string, file_id long, positions array<int>, segment int, range int"
_CATALOGUE = "first string, last string, n long, range int, segment int"
_CHANGES = "file_id long, segment int"


def _catalogue(spark: SparkSession, path: str) -> DataFrame:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/catalogue")
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(_CATALOGUE).parquet(f"{path}/catalogue") if there else spark.createDataFrame([], _CATALOGUE)


def _segments(spark: SparkSession, path: str) -> list[int]:
    return sorted(r.segment for r in _catalogue(spark, path).select("segment").distinct().collect())  # one row a segment


def _write(postings: DataFrame, changed: DataFrame, path: str, segment: int, ranges: int) -> None:
    spark, at = postings.sparkSession, f"segment={segment}"
    for table in ("postings", "changes"):  # of a write that was lost
        delete_path(spark, f"{path}/{table}/{at}")
    # dealing rows into ranges reads them twice
    once = stored(postings, "postings")
    dealt = once.repartitionByRange(ranges, "token", "file_id").sortWithinPartitions("token", "file_id").withColumn("range", F.spark_partition_id())
    dealt.write.option("compression", "zstd").partitionBy("range").parquet(f"{path}/postings/{at}")
    released(once)
    changed.select("file_id").distinct().write.parquet(f"{path}/changes/{at}")
    written = spark.read.schema("token string, file_id long, range int").parquet(f"{path}/postings/{at}")
    ends = written.groupBy("range").agg(F.min("token").alias("first"), F.max("token").alias("last"), F.count("*").alias("n"))
    # a segment without postings has an entry, too, or it wouldn't count
    ends = spark.createDataFrame([(None, None, 0, -1)], "first string, last string, n long, range int").unionByName(ends.select("first", "last", "n", "range"))
    ends.coalesce(1).write.mode("overwrite").parquet(f"{path}/catalogue/{at}")


def write_index(files: DataFrame, path: str, removed: DataFrame | None = None, folded: bool = True, ranges: int | None = None) -> int:
    """Adds a segment of ``files`` (``file_id``, ``content``) to the index at ``path`` and returns its number; the first one makes the index.

    Files that the index knows are replaced, those of ``removed`` (``file_id``) go. Only ``files`` are read. The tokens of a null or empty content are none.
    """
    spark = files.sparkSession
    segment = max(_segments(spark, path), default=-1) + 1
    changed = files.select("file_id") if removed is None else files.select("file_id").unionByName(removed.select("file_id"))
    _write(build_index(files, folded), changed, path, segment, ranges or partitions(spark))
    return segment


def _live(postings: DataFrame, path: str, segments: list[int]) -> DataFrame:
    """Postings of the last segment that speaks of their file. The first segment replaces nothing, so its list of files isn't read."""
    if len(segments) > 1:
        changes = postings.sparkSession.read.schema(_CHANGES).parquet(f"{path}/changes").where(F.col("segment").isin(segments[1:]))
        last = changes.groupBy("file_id").agg(F.max("segment").alias("last"))
        postings = postings.join(last, "file_id", "left").where("last IS NULL OR segment = last")
    return postings.select("token", "file_id", "positions")


def open_index(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    """``token``, ``file_id``, ``positions`` of the index at ``path``; with ``text``, of its tokens alone, from the ranges that may hold them."""
    catalogue, segments = _catalogue(spark, path), _segments(spark, path)
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings") if segments else spark.createDataFrame([], _POSTINGS)
    postings = postings.where(F.col("segment").isin(segments))
    if text is not None:
        wanted = tokens_of(text)
        within = reduce(lambda a, b: a | b, [(F.col("first") <= t) & (F.col("last") >= t) for t in wanted], F.lit(False))
        # a token is in one range of a segment, or in as many as its files fill
        spots = catalogue.where(within).groupBy("segment").agg(F.collect_list("range").alias("ranges")).collect()
        read = reduce(lambda a, b: a | b, [(F.col("segment") == s.segment) & F.col("range").isin(s.ranges) for s in spots], F.lit(False))
        postings = postings.where(read & F.col("token").isin(wanted))
    return _live(postings, path, segments)


def compact(spark: SparkSession, path: str, ranges: int | None = None) -> int:
    """Writes all live postings as one segment, then deletes the others; returns its number. Searches that began before may have to be repeated."""
    old = _segments(spark, path)
    if len(old) < 2:
        return max(old, default=-1)
    live = open_index(spark, path)
    _write(live, spark.read.schema(_CHANGES).parquet(f"{path}/changes").where(F.col("segment").isin(old)), path, old[-1] + 1, ranges or partitions(spark))
    for table in ("catalogue", "postings", "changes"):
        for segment in old:
            delete_path(spark, f"{path}/{table}/segment={segment}")
    return old[-1] + 1
