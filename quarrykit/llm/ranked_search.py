"""Ranked lexical search of all documents for each of many items, with thresholds seeded by stored impacts.

A term's weight in a document is its impact; the k best impacts of each term are stored. They bound each item's k-th score from
below: by the k-th impact of its best term, and by the exact scores of the documents that they belong to. Terms whose best impacts
together stay below that bound can't lift a document over it, so documents are looked up by an item's other terms alone, and those
whose score may still reach the bound are scored exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.buckets import at_most
from quarrykit.llm.common import released, stored

TOP = 10
#: Terms of all items, and their bytes, up to which every task gets them; beyond, documents' terms meet them in a join.
MOST_TERMS, MOST_BYTES = 500_000, 32_000_000
#: ASCII letters in lower case, other ASCII characters that aren't digits as spaces; all other bytes are parts of terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a text in UTF-8: runs of ASCII letters and digits and all characters beyond ASCII, A to Z in lower case."""
    counts = Counter(text.translate(_FOLD).split(b" "))
    del counts[b""]
    return counts


def _vectors(known: Callable[[], dict[bytes, int]] | None) -> object:
    """Terms and counts of each text that has a term; with ``known``, only its terms, by their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = None if known is None else known()
        for batch in batches:
            at, sizes, lengths, terms, counts = [], [], [], [], []
            for k, text in enumerate(batch["text"]):
                found = term_counts(text.as_py() or b"")
                if not found:
                    continue
                at.append(k)
                lengths.append(found.total())
                if numbers is not None:
                    found = {numbers[t]: c for t, c in found.items() if t in numbers}
                sizes.append(len(found))
                terms += found.keys()
                counts += found.values()
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))
            words = pa.array(terms, pa.binary()).cast(pa.string()) if numbers is None else pa.array(terms, pa.int64())
            part = batch.take(pa.array(at, pa.int64()))
            arrays = [part["row"], part["id"], pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "n", "terms", "counts"])

    return count


def _counted(table: DataFrame, id_col: str, text_col: str, known: Callable[[], dict[bytes, int]] | None, name: str) -> DataFrame:
    """Stored rows (``row``, ``id``, ``n``, ``terms``, ``counts``) of the texts that have a term. Rows are numbered, so repeated ids stay apart."""
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(_vectors(known), f"row long, id {kind}, n long, terms array<{'string' if known is None else 'long'}>, counts array<long>"), name)


def _each(vectors: DataFrame, term: str, count: str) -> DataFrame:
    return vectors.select("row", "n", F.inline(F.arrays_zip("terms", "counts"))).withColumnsRenamed({"terms": term, "counts": count})


def _postings(docs: DataFrame, words: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Counted documents, and their terms that items have: ``row``, ``n``, ``t`` (a term's number), ``tf``."""
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n <= MOST_TERMS and size <= MOST_BYTES:
        numbers = docs.sparkSession.sparkContext.broadcast({r.term.encode(): r.t for r in words.select("term", "t").toLocalIterator()})
        vectors = _counted(docs, id_col, text_col, lambda: numbers.value, "vectors")
        return vectors, _each(vectors, "t", "tf")
    vectors = _counted(docs, id_col, text_col, None, "vectors")
    met = _each(vectors, "term", "tf").join(words, "term").select("row", "n", "t", "tf")
    return vectors, stored(met, "postings")


def _best(table: DataFrame, of: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each ``of``, with their ``rank``; tasks drop what can't be among them before the shuffle."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy(*order))).where(F.col("rank") <= k)


def _scores(pairs: DataFrame, postings: DataFrame, plan: DataFrame) -> DataFrame:
    """Exact ``score`` of each pair (``item``, ``row``; stored)."""
    met = postings.join(at_most(pairs), "row").select("item", "row", "t", "impact")
    return met.join(at_most(plan.select("item", "t", "gain")), ["item", "t"]).groupBy("item", "row").agg(F.sum(F.col("gain") * F.col("impact")).alias("score"))


def _kth(scored: DataFrame, k: int) -> DataFrame:
    return _best(scored, "item", [F.desc("score"), F.col("row")], k).where(F.col("rank") == k).select("item", F.col("score").alias("seeded"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: its id, ``rank`` (from 1), the document's id and ``score``.

    With N documents that have a term and L terms in all, a term in df documents weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), and a document of n
    terms that holds it tf times has its impact (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L. A score sums w times impact over an
    item's terms, repeats included. Null and empty texts have no terms: such documents count nowhere, such items have no rows. Equal scores
    go by id, null ids first, then by row. Rows with one id are items or documents of their own, each with its ranks. Other columns
    are neither read nor returned. Empty tables give no rows.
    """
    named = _counted(items, item_col, item_text_col, None, "items")
    wanted = _each(named, "term", "q").select(F.col("row").alias("item"), "term", "q")
    words = stored(wanted.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t")), "words")
    vectors, postings = _postings(docs, words, id_col, text_col)
    n, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(25) + F.expr(f"(75L * n * {n}L) div {max(total, 1)}L")
    postings = postings.withColumn("m", m).select("row", "t", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)").alias("impact"))

    # stored impacts: the k best of each term, and how many documents hold it
    best = stored(_best(postings, "t", [F.desc("impact"), F.col("row")], k).select("t", "row", "impact", "rank"), "impacts")
    ends = best.groupBy("t").agg(F.max("impact").alias("highest"), F.max(F.when(F.col("rank") == k, F.col("impact"))).alias("kth"))
    held = postings.groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    gain = (F.col("q") * F.col("w")).alias("gain")
    plan = wanted.join(words, "term").join(held.withColumn("w", weight), "t").join(ends, "t").select("item", "t", gain, "highest", F.coalesce("kth", F.lit(0)).alias("kth"))
    plan = stored(plan, "plan")

    # bounds of each item's k-th score
    seeds = stored(at_most(plan).join(best.select("t", "row"), "t").select("item", "row").distinct(), "seeds")
    seeded = _kth(_scores(seeds, postings, plan), k)
    bounds = plan.groupBy("item").agg(F.max(F.col("gain") * F.col("kth")).alias("single")).join(seeded, "item", "left")
    bounds = bounds.select("item", F.greatest("single", F.coalesce("seeded", F.lit(0))).alias("bound"))

    # terms from the smallest on, as long as all of them together stay below the bound, are looked up by no one
    most = F.col("gain") * F.col("highest")
    upto = F.sum(most).over(Window.partitionBy("item").orderBy(most, "t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    judged = stored(plan.join(bounds, "item").withColumn("upto", upto), "judged")
    rest = judged.groupBy("item").agg(F.coalesce(F.max(F.when(F.col("upto") < F.col("bound"), F.col("upto"))), F.lit(0)).alias("rest"))
    leading = stored(judged.where("upto >= bound").join(rest, "item").select("item", "t", "gain", (F.col("bound") - F.col("rest")).alias("least")), "leading")
    parts = postings.join(at_most(leading), "t").groupBy("item", "row").agg(F.sum(F.col("gain") * F.col("impact")).alias("part"), F.first("least").alias("least"))
    candidates = stored(parts.where("part >= least AND part > 0").select("item", "row"), "candidates")

    scored = _scores(candidates, postings, plan).where("score > 0")
    # ids join what can still be among the first, ties included
    scored = stored(scored, "scored")
    close = stored(scored.join(_kth(scored, k), "item", "left").where("seeded IS NULL OR score >= seeded").drop("seeded"), "close")
    released(words, best, plan, seeds, judged, leading, candidates, scored)
    close = vectors.select("row", F.col("id").alias(id_col)).join(at_most(close), "row")
    ranked = _best(close, "item", [F.desc("score"), F.col(id_col), F.col("row")], k)
    return ranked.join(named.select(F.col("row").alias("item"), F.col("id").alias(item_col)), "item").select(item_col, "rank", id_col, "score")
