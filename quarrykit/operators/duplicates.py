"""Duplicate blocks across files: shared runs of lines, similar files, and the blocks they share.

``lines``: ``file_id`` (long) and ``lines``, an array of ``number`` (in the file, from 1) and ``text`` (normalised, not empty). Lines are numbered and
put together inside their row, so a text isn't shuffled before its runs are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.iterate import components, stored

MIN_LINES, MIN_SIMILARITY = 6, 0.6
#: Runs that occur more often than this say nothing about pairs of files; they still make blocks.
MAX_OCCURRENCES = 30
#: What is trimmed off lines.
TRIM = r"^[\s\x85\xA0]+|[\s\x85\xA0]+$"


def plain_lines(files: DataFrame) -> DataFrame:
    """Lines of plain texts (``file_id``, ``content``): trimmed, in lower case, without empty ones."""
    each = F.transform(F.split("content", "\n"), lambda t, k: F.struct((k + 1).alias("number"), F.lower(F.regexp_replace(t, TRIM, "")).alias("text")))
    return files.select("file_id", F.filter(each, lambda x: x["text"] != "").alias("lines"))


def code_lines(files: DataFrame) -> DataFrame:
    """Lines of source files (``file_id``, ``content``, ``language``) without comments."""
    from quarrykit.functions.code import normalized_lines

    return files.select("file_id", normalized_lines("content", "language").alias("lines"))


def each_line(lines: DataFrame) -> DataFrame:
    """A row a line: ``file_id``, ``index`` (from 0, without gaps), ``number``, ``text``."""
    return lines.select("file_id", F.posexplode("lines").alias("index", "x")).select("file_id", "index", "x.number", "x.text")


def shingles(lines: DataFrame, width: int = MIN_LINES) -> DataFrame:
    """Every run of ``width`` lines: ``file_id``, ``start`` (index), ``first`` and ``last`` line numbers, ``fragment``.

    A width below 2 counts as 2.
    """
    width = max(2, width)

    def run(k: Column) -> Column:
        own = F.slice("lines", k + 1, width)
        return F.struct(k.alias("start"), own[0]["number"].alias("first"), own[width - 1]["number"].alias("last"), F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("fragment"))

    starts = F.when(F.size("lines") >= width, F.sequence(F.lit(0), F.size("lines") - width))
    return lines.select("file_id", F.inline(F.transform(starts, run)))


def similar_pairs(runs: DataFrame, similarity: float = MIN_SIMILARITY, most: int = MAX_OCCURRENCES) -> DataFrame:
    """Pairs of files (``a`` < ``b``) with shared occurrences and Dice similarity, at least ``similarity``; it may exceed 1 where runs repeat.

    Frequent runs go before the self-join, so a run adds ``most`` squared pairs at most. Runs travel as two hashes,
    not as text.
    """
    keyed = runs.select("file_id", F.xxhash64("fragment").alias("h1"), F.hash("fragment").alias("h2"))
    counts = keyed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("h1", "h2")
    usable = stored(keyed.join(counts, ["h1", "h2"]), "runs")
    left, right = usable.withColumnRenamed("file_id", "a"), usable.withColumnRenamed("file_id", "b")
    shared = left.join(right, ["h1", "h2"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sizes = runs.groupBy("file_id").agg(F.count("*").alias("n"))
    sized = shared.join(sizes.select(F.col("file_id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("file_id").alias("b"), F.col("n").alias("nb")), "b")
    dice = 2 * F.col("shared") / (F.col("na") + F.col("nb"))
    return sized.select("a", "b", "shared", dice.alias("similarity")).where(F.col("similarity") >= similarity)


def in_percent(pairs: DataFrame) -> DataFrame:
    """Pairs or groups with their similarity as whole ``percent``, 100 at most."""
    return pairs.withColumn("percent", F.floor(F.least(F.col("similarity"), F.lit(1.0)) * 100 + 0.5).cast("long"))


def _members(pairs: DataFrame) -> DataFrame:
    return components(pairs.select("a", "b")).select(F.col("node").alias("file_id"), F.col("root").alias("group_id"))


def _block_runs(runs: DataFrame, members: DataFrame) -> DataFrame:
    """Runs that occur twice or more, all in files of one group. A run in a file of no group belongs to no group."""
    grouped = runs.join(members, "file_id", "left").withColumn("group_id", F.coalesce("group_id", -1 - F.col("file_id")))
    grouped = stored(grouped.withColumns({"h1": F.xxhash64("fragment"), "h2": F.hash("fragment")}), "grouped")
    inside = grouped.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("group_id").alias("low"), F.max("group_id").alias("high"))
    inside = inside.where("n > 1 AND low = high AND low >= 0").select("h1", "h2", "n")
    return stored(grouped.join(inside, ["h1", "h2"]), "block_runs")


def duplicate_groups(runs: DataFrame, pairs: DataFrame, width: int = MIN_LINES) -> DataFrame:
    """Groups of similar files: ``group_id`` (smallest file), ``fragment`` (most frequent run, the first in order of equals), ``lines``, ``similarity`` (best of
    its pairs) and ``file_count``."""
    pairs = stored(pairs, "pairs")
    members = stored(_members(pairs), "members")
    inside = _block_runs(runs, members)
    counts = inside.groupBy("group_id", "fragment").agg(F.count("*").alias("n"))
    best = counts.groupBy("group_id").agg(F.max("n").alias("n")).join(counts, ["group_id", "n"]).groupBy("group_id").agg(F.min("fragment").alias("fragment"))
    files = inside.select("group_id", "file_id").distinct().groupBy("group_id").agg(F.count("*").alias("file_count")).where("file_count > 1")
    similar = pairs.join(members, pairs.a == members.file_id).groupBy("group_id").agg(F.max("similarity").alias("similarity"))
    return files.join(best, "group_id").join(similar, "group_id").select("group_id", "fragment", F.lit(max(2, width)).cast("long").alias("lines"), "similarity", "file_count")


def merge_runs(starts: DataFrame, width: int = MIN_LINES) -> DataFrame:
    """Overlapping runs joined (``group_id``, ``file_id``, ``start``, ``first``, ``last``); runs that only touch stay apart."""
    order = Window.partitionBy("group_id", "file_id").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("start").over(order) >= max(2, width), F.lit(True))
    islands = starts.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(order))
    return islands.groupBy("group_id", "file_id", "island").agg(F.min("first").alias("start_line"), F.max("last").alias("end_line")).drop("island")


def duplicate_blocks(runs: DataFrame, pairs: DataFrame, width: int = MIN_LINES) -> DataFrame:
    """Line ranges of each file that its group shares: ``group_id``, ``file_id``, ``start_line``, ``end_line``."""
    inside = _block_runs(runs, stored(_members(stored(pairs, "pairs")), "members"))
    files = inside.select("group_id", "file_id").distinct().groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    starts = inside.select("group_id", "file_id", "start", "first", "last").distinct().join(files, "group_id", "left_semi")
    return merge_runs(starts, width)


def nested_groups(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """Groups with their blocks in an array, ordered by file and line; largest first."""
    own = blocks.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("file_id", "start_line", "end_line"))).alias("blocks"))
    return groups.join(own, "group_id", "left").orderBy(F.desc("lines"), "group_id")
