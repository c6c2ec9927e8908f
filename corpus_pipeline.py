"""A training-data pipeline of five corpus operators.

Quality rules, then near-duplicate documents, then repeated strings, then the mix of sources, then packing. Each stage's result
is written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from quarrykit.llm.buckets import at_most
from quarrykit.llm.common import stored
from quarrykit.llm.queries import tokenizer_path


#: Columns of documents. Others are carried along, under names that no operator uses.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's rows with the columns of ``docs``, also where an operator has results of the same names."""
    names = {c: f"_carried{k}" for k, c in enumerate(c for c in docs.columns if c not in COLUMNS)}
    if not names:
        return stage(docs).select(docs.columns)
    return stage(docs.withColumnsRenamed(names)).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and every rule."""
    return _apart(docs, lambda own: quality.quality(own).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 join: the one with the smallest id (nulls last), one row of it.

    Rows are numbered in a written table, so that those with the same or no id are judged one by one.
    """
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    judged = jaccard_join.jaccard_join(numbered, width=5, threshold=0.8, row_col=row)
    removed = stored(judged.where("NOT kept").select(row), "removed")
    return numbered.join(at_most(removed), row, "left_anti").select(docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 50 bytes that an earlier one has; those with nothing left go."""

    def clean(own: DataFrame) -> DataFrame:
        cleaned = suffix_dedup.remove_repeats(own, length=50)
        cleaned = cleaned.where("n_removed = 0 OR n_removed < n_bytes")
        return cleaned.withColumn("n_chars", F.length("text").cast("long"))

    return _apart(docs, clean)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, by Poisson draws that bring sources to the weights of their square-rooted sizes."""
    return _apart(docs, lambda own: mixing.mix_sources(own, seed=17, temperature=0.5, total=1.0))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all copies, placed in sequences of 4096 tokens."""
    placed = packing.pack_documents(docs, tokenizer_path())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Stages 2, 3 and 5 can't be said in SQL. tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
