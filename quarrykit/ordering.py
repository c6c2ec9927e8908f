"""Tables in a total order: row numbers and pages without a sort of everything in one place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.iterate import new_path, partitions

#: Bits of a monotonically increasing id that number the rows of a partition.
_ROWS = 33


@dataclass(frozen=True)
class Ordered:
    """A table written in ranges of its order, a folder each. ``starts``: each folder's number and how many rows lie before it."""

    table: DataFrame
    starts: list[tuple[int, int]]
    total: int

    def rows(self, offset: int, limit: int) -> DataFrame:
        """The rows from ``offset`` on, ``limit`` at most, in order. Only the folders that hold some of them are read."""
        first, stop = max(0, offset), min(max(0, offset) + max(0, limit), self.total)
        ends = [start for _, start in self.starts[1:]] + [self.total]
        within = [part for (part, start), end in zip(self.starts, ends) if start < stop and end > first]
        hit = self.numbered().where(F.col("_part").isin(within) & (F.col("row_number") > first) & (F.col("row_number") <= stop)) if within else self.numbered().where("false")
        return hit.orderBy("row_number").drop("row_number", "_part")

    def numbered(self) -> DataFrame:
        """All rows with their ``row_number`` in the order, from 1."""
        # as many starts as folders
        before = F.create_map(*[F.lit(x) for pair in self.starts for x in pair])[F.col("_part")] if self.starts else F.lit(0)
        return self.table.withColumn("row_number", (before + F.col("_at") + 1).cast("long")).drop("_at")


def ordered(table: DataFrame, *order: Column | str, ranges: int | None = None) -> Ordered:
    """Writes ``table`` in a total order: rows are dealt into ranges of it, sorted there, and each range is a folder.

    Rows before a place are counted by range, so a row's number needs neither a window over everything nor a sort on the driver. Rows that are equal in ``order`` have no
    order of their own, and lie in one range.
    """
    spark = table.sparkSession
    path = new_path(spark, "ordered")
    sorted_ = table.repartitionByRange(ranges or partitions(spark), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    split = sorted_.select(*table.columns, F.expr(f"_id & ((1L << {_ROWS}) - 1)").alias("_at"), F.shiftright("_id", _ROWS).cast("int").alias("_part"))
    split.write.option("compression", "zstd").partitionBy("_part").parquet(path)
    written = spark.read.schema(split.schema).parquet(path)
    counts = sorted((r["_part"], r["n"]) for r in written.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row a range
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    return Ordered(written, starts, total)
