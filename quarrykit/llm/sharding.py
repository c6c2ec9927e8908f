"""Contiguous shards of near-equal byte size, cut from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import partitions, shared_dir, stored

ROW_OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, overhead: int = ROW_OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places every row in one of ``n_shards`` shards that are contiguous in order of ``id_col``.

    Only (id, size, CRC-32) travel, never the text: one range shuffle puts them in order, a first pass adds
    up the bytes and rows of each partition, and a second one streams through each partition with the sum
    of all before it. A row goes to the shard in whose share of the bytes its middle byte falls, so each
    shard misses its equal target by one row's size at most.

    Returns ``id_col``, ``size``, ``text_crc32``, ``shard``, ``slot`` (place in the shard, from 0).
    Null texts have no bytes but the overhead. Null ids come first. Rows with the same id are ordered by size
    and CRC-32; whole repeats take neighbouring slots. An empty table gives an empty result. Other columns are
    ignored. With fewer rows than shards, or one row larger than a target, some shards stay empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    shared_dir(spark)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    sized = stored(sized, "sized")
    # a checkpoint keeps partitions and their order; the partition's number is kept with its rows
    ranged = sized.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    # one row a partition: their number is a setting, not a property of the data
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    starts: dict[int, tuple[int, int]] = {}
    at_byte = at_row = 0
    for part, n_bytes, n_rows in sorted(totals):
        starts[part] = (at_byte, at_row)
        at_byte, at_row = at_byte + n_bytes, at_row + n_rows
    total = at_byte

    cuts = np.array([-(-2 * total * k // n_shards) for k in range(1, n_shards)], dtype=np.int64)  # of twice the middle byte

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = row = None
        for batch in batches:
            if len(batch):
                if before is None:
                    before, row = starts[int(batch.part.iloc[0])]
                ends = before + batch["size"].to_numpy().cumsum()
                shard = np.searchsorted(cuts, 2 * ends - batch["size"].to_numpy(), side="right").astype(np.int32)
                yield batch[["doc_id", "size", "text_crc32"]].assign(shard=shard, rank=range(row, row + len(batch)))
                before, row = int(ends[-1]), row + len(batch)

    placed = stored(ranged.mapInPandas(place, "doc_id long, size long, text_crc32 long, shard int, rank long"), "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # n_shards rows at most
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes ``docs`` as one folder a shard. Ids must be unique here; rows go to their shard's files in slot order."""
    rows = docs.join(placed.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    rows.repartition("shard", F.expr("slot div 50000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
