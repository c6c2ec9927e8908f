"""Self-join of documents on the Jaccard similarity of word shingles, with Bayesian pruning of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.buckets import at_most, block_count, compare_groups, likely_links, set_links, shared_buckets
from quarrykit.llm.common import components, released, stored
from quarrykit.llm.shingles import band_keys, mixed, multipliers, shingle_set, signature, slices_of, texts_of

WIDTH, THRESHOLD = 5, 0.8
#: At similarity 0.8, all bands of a pair differ with probability (1 - 0.8^5)^40, about 1e-7.
BANDS, ROWS = 40, 5
#: Rows of a block where only signatures are compared.
BLOCK = 4096
_SETS = "doc_id long, row long, t1 long, t2 int, h1 long, h2 long, n long, sig binary, bands array<long>"


def _describe(width: int) -> object:
    factors = multipliers(BANDS * ROWS)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, n, sigs, bands = [], [], [], [], []
            for data in texts_of(batch["text"]):
                own = shingle_set(data, width)
                n.append(len(own))
                h1.append(int(np.add.reduce(mixed(own)).view(np.int64)) if len(own) else 0)
                h2.append(int(np.bitwise_xor.reduce(mixed(own + np.uint64(1))).view(np.int64)) if len(own) else 0)
                sig = signature(own, factors)
                sigs.append(sig.astype(np.uint8).tobytes() if len(own) else None)
                bands.append(band_keys(sig, BANDS).view(np.int64) if len(own) else None)
            arrays = [batch["doc_id"], batch["row"], batch["t1"], batch["t2"], pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SETS.split(", ")])

    return describe


def _fetch(width: int) -> object:
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that are equal in id and text have one node
        for batch in batches:
            for begin, texts in slices_of(batch["text"]):
                part = batch.slice(begin, len(texts))
                new = []
                for k, node in enumerate(part["node"].to_pylist()):
                    if node not in seen:
                        seen.add(node)
                        new.append(k)
                part = part.take(pa.array(new, pa.int64()))
                sets = [shingle_set(texts[k], width).tobytes() for k in new]
                yield pa.RecordBatch.from_arrays([part["node"], part["root"], part["weight"], pa.array(sets, pa.binary())], names=["node", "root", "weight", "value"])

    return fetch


def _loose(nodes: DataFrame, met: DataFrame) -> DataFrame | None:
    """Stored ``root`` of the components too large for one block whose buckets hold fewer pairs than they do: chains, not thick groups."""
    wide = nodes.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    wide = stored(wide.where(block_count(F.col("size"), 8 * F.col("shingles")) > 1).select("root", "size"), "wide")
    if wide.isEmpty():
        released(wide)
        return None
    places = met.join(nodes.select("node", "root").join(at_most(wide), "root"), "node").groupBy("root", "bucket").agg(F.count("*").alias("n"))
    pairs = places.groupBy("root").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    found = stored(pairs.join(wide, "root").where(F.col("pairs") < F.col("size").cast("double") * F.col("size")).select("root"), "loose")
    released(wide)
    if found.isEmpty():
        released(found)
        return None
    return found


def _meetings(nodes: DataFrame, met: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Stored places (``node``, ``bucket``, ``keys``) where ``nodes`` must be verified: each pair that values don't rule out has one, its first shared bucket."""
    signed = met.join(nodes.select("node"), "node").join(reps.select("node", "sig", F.col("bands").alias("keys")), "node")
    signed = signed.select("node", F.col("bucket").alias("root"), F.lit(1).cast("long").alias("weight"), F.col("sig").alias("value"), "keys")
    tried = compare_groups(signed, likely_links(threshold, BANDS * ROWS), block=BLOCK)
    places = tried.select("node", F.col("root").alias("bucket")).distinct().join(reps.select("node", F.col("bands").alias("keys")), "node")
    found = stored(places, "places")
    released(tried)
    return found


def jaccard_join(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Links documents whose sets of ``width``-word shingles have a Jaccard similarity of ``threshold`` or more.

    Returns one row per document: ``doc_id``, ``class_id`` (smallest id with the same set), ``n_links`` (other documents linked
    with it), ``component_id`` (smallest id reachable by links, itself included) and ``kept`` (it is the first of its component:
    that with the smallest id, and among rows with that id the first). With ``row_col``, a column of ``docs`` that numbers
    its rows (longs, no two equal), the result has that column too, and "first" goes by it.

    1. Documents with equal sets form a class, which is compared once. 2. Classes that agree in a band of MinHash values
    share a bucket; there, values are compared step by step, and pairs go as soon as their posterior probability of reaching the
    threshold is below ``TOLERANCE``. A bucket hands on a forest of the pairs that are left. 3. In each component of
    these, pairs are pruned so again, and the rest are verified on whole sets, block by block. A block passes on
    sums and a forest of links only, so a large group costs comparisons, never rows. A component of several blocks that hangs
    together by few pairs, like a chain, isn't compared as a whole: each of its pairs is verified in its first shared bucket, and a set
    goes only to buckets where it has such a pair.

    A word is a run of characters other than ASCII white space. A text of fewer words than ``width`` is one shingle. Null texts and texts without
    words are linked with nothing, and kept. Rows with the same or no id are documents of their own; ids only name them. Null ids come after
    all others, and a class or component of null ids alone has a null id. An empty table gives an empty result; other columns are ignored.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("long").alias("row"), F.xxhash64(text_col).alias("t1"), F.hash(text_col).alias("t2"), F.col(text_col).alias("text"))
    sets = stored(rows.mapInArrow(_describe(width), _SETS), "sets")
    worded = sets.where("n > 0")
    same = ["h1", "h2", "n"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")  # nulls last
    # a class is known by its first row's number, which no other class has
    classes = stored(worded.groupBy(*same).agg(first, F.count("*").alias("weight")).withColumn("node", F.col("first.row")), "classes")
    reps = stored(worded.join(classes.select("node", "weight"), F.col("row") == F.col("node")).select("node", "weight", "doc_id", "t1", "t2", "n", "sig", "bands"), "reps")
    met = shared_buckets(reps.select("node", F.explode("bands").alias("key")))
    signed = met.join(reps.select("node", "sig"), "node").select("node", F.col("bucket").alias("root"), F.lit(1).cast("long").alias("weight"), F.col("sig").alias("value"))
    ties = compare_groups(signed, likely_links(threshold, BANDS * ROWS), count=False, block=BLOCK)
    groups = components(ties.select(F.col("node").alias("a"), F.col("to").alias("b")))
    nodes = stored(reps.drop("sig", "bands").join(groups, "node"), "nodes")
    released(ties)
    loose = _loose(nodes, met)

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = at_most(some)
        texts = rows.drop("row").join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["t1"] == wanted["t1"]) & (rows["t2"] == wanted["t2"])).select("node", "root", "weight", "text")
        return texts.mapInArrow(_fetch(width), "node long, root long, weight long, value binary")

    exact = set_links(threshold, multipliers(BANDS * ROWS))
    if loose is None:
        found = compare_groups(sets_of(nodes), exact)
        released(met, reps)
    else:
        thick, thin = stored(nodes.join(loose, "root", "left_anti"), "thick"), stored(nodes.join(loose, "root", "left_semi"), "thin")
        places = _meetings(thin, met, reps, threshold)
        released(met, reps, loose)
        values = stored(sets_of(thin), "values")
        here = values.drop("root").join(places.withColumnRenamed("bucket", "root"), "node")
        whole, parts = compare_groups(sets_of(thick), exact), compare_groups(here, exact)
        found = stored(whole.unionByName(parts.drop("root")), "found")
        released(thick, thin, places, values, whole, parts)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    linked = stored(links.join(roots, "node"), "linked")
    # written before they meet, so that a large component's join can be split
    judged = stored(classes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    ends = stored(judged.groupBy("root").agg(F.min("first").alias("end")), "ends")
    judged = stored(judged.join(ends, "root").select(*same, F.col("first.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("end.doc_id").alias("component_id"), (F.col("end.row")).alias("kept_row")), "judged")
    released(nodes, found, linked)
    plain = sets.select("doc_id", "row", *same).where("n > 0").join(judged, same)
    alone = sets.where("n = 0").select("doc_id", "row", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.col("row").alias("kept_row"))
    done = plain.select(alone.columns).unionByName(alone).withColumn("kept", F.col("row") == F.col("kept_row")).drop("kept_row")
    return done.withColumnRenamed("row", row_col) if row_col else done.drop("row")
