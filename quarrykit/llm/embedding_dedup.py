"""Near-duplicate vectors by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import components, find_roots, stored

THRESHOLD = 0.98
#: Rows that the codebooks of a vector length are fitted on at most, and the fewest of them for each code. Cells grow with the table up to (20,000 / 8)^2, or
#: 400 million vectors of each label at ``FILL``; a larger ``sample`` carries that on.
SAMPLE, LEAST_ROWS = 20_000, 8
#: Vectors of one label that a cell should hold.
FILL = 64
#: Share of pairs at the threshold whose cell a traversal must reach, from either side.
RECALL = 0.995
#: Residents and guests of a cell that meet in one task's group.
RESIDENTS, GUESTS = 1024, 4096
BROADCAST_ROWS = 200_000
#: Vector lengths whose codebooks tasks hold at once.
LENGTHS = 8


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks, for the first and the second half of unit vectors; their product is a grid of cells."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    @property
    def codes(self) -> int:
        return len(self.first)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squares(x[:, :half], self.first), _squares(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * self.codes + b.argmin(axis=1)

    def traverse(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` nearest cells of each vector, nearest first, from the two sorted lists of codes.

        A pair of ranks (i, j) is behind all (i + 1)(j + 1) pairs that are no greater in both, so only pairs
        with (i + 1)(j + 1) <= visits can be among them.
        """
        a, b = self.distances(x)
        order_a, order_b = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        ranks = [(i, j) for i in range(min(self.codes, visits)) for j in range(min(self.codes, visits // (i + 1)))]
        i, j = np.array(ranks).T
        code_a, code_b = order_a[:, i], order_b[:, j]
        total = np.take_along_axis(a, code_a, 1) + np.take_along_axis(b, code_b, 1)
        nearest = total.argsort(axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(code_a * self.codes + code_b, nearest, 1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, 2**22 // len(centres))
    return np.concatenate([_squares(x[lo : lo + step], centres).argmin(axis=1) for lo in range(0, len(x), step)])


def _codebook(x: np.ndarray, codes: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means."""
    centres = x[rng.choice(len(x), codes, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=codes)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit_index(sample: np.ndarray, codes: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 3) -> MultiIndex:
    """Codebooks of unit vectors, and how many cells a traversal visits.

    The number of visits is measured: sample vectors are moved in random directions to the threshold's angle, and
    enough cells are visited to meet ``recall`` of the moved ones.
    """
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    codes = max(1, min(codes, len(np.unique(sample[:, :half], axis=0)), len(np.unique(sample[:, half:], axis=0))))
    index = MultiIndex(_codebook(sample[:, :half], codes, rng), _codebook(sample[:, half:], codes, rng), 1)
    if codes == 1:
        return index
    x = sample[rng.integers(0, len(sample), 4000)]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    moved = index.cells(threshold * x + np.sqrt(1 - threshold**2) * noise)
    a, b = index.distances(x)
    # cells nearer than the one that the moved vector is in: for each code of the first book, those codes of the second that are near enough
    at = np.arange(len(x))
    far = a[at, moved // codes] + b[at, moved % codes]
    behind = [int(np.searchsorted(np.sort(b[k]), far[k] - a[k]).sum()) for k in at]
    visits = int(np.quantile(behind, recall, method="higher")) + 1
    return MultiIndex(index.first, index.second, visits)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.frombuffer(v, dtype=np.float64) for v in vectors])
    scale = np.abs(x).max(axis=1)[:, None]  # else squares of very large or small numbers are lost
    x = x / scale
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _valid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes and length of the vectors that can link; null for the others."""
    for batch in batches:
        vectors, dims = [], []
        for v in batch.embedding:
            x = None if v is None else np.array([np.nan if y is None else y for y in v], dtype=np.float64)
            ok = x is not None and len(x) > 0 and np.isfinite(x).all() and x.any()
            vectors.append(x.tobytes() if ok else None)
            dims.append(len(x) if ok else 0)
        yield batch.drop(columns="embedding").assign(dim=dims, vector=vectors)


def _deal(grids: dict[int, MultiIndex]) -> object:
    """Homes and visited cells of vectors, by the grid of their length; without a grid, a length has one cell."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.iloc[lo : lo + 1024].reset_index(drop=True)
                cell = np.zeros(len(part), dtype=np.int64)
                lists = [[0]] * len(part)
                for dim, index in grids.items():
                    known = np.flatnonzero(part.dim.to_numpy() == dim)
                    if len(known):
                        x = _unit(part.vector.iloc[known])
                        cell[known] = index.cells(x)
                        for k, row in zip(known, index.traverse(x, min(index.visits, index.codes**2)).tolist(), strict=True):
                            lists[k] = row
                visits = [sorted({*v, int(c)}) for v, c in zip(lists, cell, strict=True)]
                part = part.assign(home=cell, visits=visits, seen=[np.array(v, dtype=np.int64).tobytes() for v in visits])
                yield part[["node", "label", "dim", "weight", "home", "visits", "seen", "vector"]]

    return deal


def _compare(threshold: float) -> object:
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        resident = (group.home == first.cell) & (group.block == first.i) & group.resident
        own, guests = group[resident.to_numpy()], group[~resident.to_numpy()]
        nodes = np.concatenate([own.node.to_numpy(), guests.node.to_numpy()])
        weight = np.concatenate([own.weight.to_numpy(), guests.weight.to_numpy()])
        found = []
        if len(own):
            x = _unit(own.vector)
            if first.j == 0:
                a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                found.append((a, b))
            if len(guests):
                linked = x @ _unit(guests.vector).T >= threshold
                # a guest from another cell may meet a resident at home too: the cell with the smaller number counts them
                home = guests.home.to_numpy()
                homes, of = np.unique(home, return_inverse=True)
                seen = np.stack([np.isin(homes, np.frombuffer(s, dtype=np.int64)) for s in own.seen])
                elsewhere = seen[:, of] & (home < first.cell)[None, :]
                a, b = np.nonzero(linked & ~elsewhere)
                found.append((a, b + len(own)))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        links = np.bincount(a, weight[b], len(nodes)) + np.bincount(b, weight[a], len(nodes))
        order = np.argsort(nodes, kind="stable")
        rank = np.empty(len(nodes), dtype=np.int64)
        rank[order] = np.arange(len(nodes))
        root = nodes[order][find_roots(rank[a], rank[b], len(nodes))[rank]]
        hit = links > 0
        return pd.DataFrame({"node": nodes[hit], "links": links[hit].astype(np.int64), "to": root[hit]})

    return compare


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, codes: int | None = None, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of equal labels whose cosine is ``threshold`` or more.

    Returns one row per vector: ``vec_id``, ``n_links`` (other vectors linked with it), ``component_id`` (smallest id reachable by links, itself
    included) and ``kept`` (it is that vector).

    Each vector length has a grid of its own, whose codebooks are fitted on at most ``sample`` vectors of it, chosen by a hash of the row; lengths of up to ``FILL``
    vectors have one cell. Every vector is indexed. Each vector is
    a resident of its cell and a guest in the cells that its traversal visits, as many as reach ``recall`` of
    pairs at the threshold; all found pairs are verified in double precision. Equal vectors of a label are compared
    once. Large cells are split into blocks of residents and guests that meet block by block; a block passes on sums
    and a forest of links only.

    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of
    different lengths don't link. Repeated rows, and
    rows with the same or no id, are vectors of their own. Null ids come after all others; a component of null ids alone has a null id, and its
    first row is kept. An empty table gives an empty result; other columns are ignored.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    base = base.withColumn("none", F.col("vec_id").isNull()).withColumn("vec_id", F.coalesce("vec_id", F.lit(0)))
    rows = stored(base.mapInPandas(_valid, "vec_id long, row long, label string, none boolean, dim long, vector binary"), "vectors")
    able = rows.where("vector IS NOT NULL AND label IS NOT NULL").withColumn("code", F.md5("vector"))
    same = ["label", "dim", "code"]
    # a class is known by its first row's number, which no other class has
    classes = able.groupBy(*same).agg(F.min(F.struct("none", "vec_id", "row")).alias("first"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("node", F.col("first.row")), "classes")
    reps = stored(able.join(classes.select("node", "weight"), F.col("row") == F.col("node")).select("node", "label", "dim", "weight", "vector"), "reps")
    lengths = reps.groupBy("dim").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).orderBy(F.desc("n"), "dim").collect()  # a row a length
    ids = ["vec_id", "none", "row"]
    plain = rows.where("vector IS NULL OR label IS NULL").select(*ids, F.lit(0).cast("long").alias("n_links"), F.struct("none", "vec_id", "row").alias("end"))
    if not lengths:
        return _named(plain)
    wide = [r for r in lengths if r.dim > 1 and r.n > FILL]
    columns = reps.select("node", "label", "dim", "weight", "vector")
    schema = "node long, label string, dim long, weight long, home long, visits array<long>, seen binary, vector binary"
    dealt = []
    for lo in range(0, max(1, len(wide)), LENGTHS):
        grids = {}
        for r in wide[lo : lo + LENGTHS]:
            drawn = reps.where(F.col("dim") == r.dim).orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toPandas()
            size = codes or max(2, min(len(drawn) // LEAST_ROWS, round((r.n / max(1, r.labels) / FILL) ** 0.5)))
            grids[r.dim] = fit_index(_unit(drawn.vector), size, threshold, recall)
        here = [r.dim for r in (lengths if len(wide) <= LENGTHS else wide[lo : lo + LENGTHS])]
        dealt.append(stored(columns.where(F.col("dim").isin(here)).mapInPandas(_deal(grids), schema), "dealt"))
    if len(wide) > LENGTHS:
        dealt.append(stored(columns.where(~F.col("dim").isin([r.dim for r in wide])).mapInPandas(_deal({}), schema), "dealt"))
    dealt = reduce(DataFrame.unionByName, dealt)
    keys = ["label", "dim", "cell"]
    calls = dealt.select("label", "dim", F.explode("visits").alias("cell"), "home")
    counts = calls.groupBy(*keys).agg(F.count_if(F.col("cell") == F.col("home")).alias("residents"), F.count("*").alias("all"))
    counts = counts.where("residents > 0").select(*keys, F.ceil(F.col("residents") / RESIDENTS).cast("int").alias("blocks"), F.ceil(F.col("all") / GUESTS).cast("int").alias("chunks"))
    counts = stored(counts, "cells")
    calls = dealt.withColumn("cell", F.explode("visits")).drop("visits")
    calls = calls.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, keys)
    at_home = F.col("home") == F.col("cell")
    calls = calls.withColumn("block", F.when(at_home, F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")).otherwise(-1))
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks").cast("long")).cast("int")
    here = calls.where(at_home).withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("resident", F.lit(True))
    # guests meet all blocks; residents are guests of the blocks before their own
    last = F.when(at_home, F.col("block") - 1).otherwise(F.col("blocks") - 1)
    away = calls.where(~at_home | (F.col("block") > 0)).withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("j", chunk).withColumn("resident", F.lit(False))
    columns = ["node", "weight", "home", "seen", "vector", "block", "resident", *keys, "i", "j"]
    met = here.select(columns).unionByName(away.select(columns))
    found = stored(met.groupBy(*keys, "i", "j").applyInPandas(_compare(threshold), "node long, links long, to long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    # written before they meet, so that a large component's join can be split
    judged = stored(classes.join(stored(links.join(roots, "node"), "linked"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    ends = stored(judged.groupBy("root").agg(F.min("first").alias("end")), "ends")
    judged = stored(judged.join(ends, "root").select(*same, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "end"), "judged")
    return _named(able.join(judged, same).select(*ids, "n_links", "end").unionByName(plain))


def _named(done: DataFrame) -> DataFrame:
    def name(x: str, none: str) -> Column:
        return F.when(~F.col(none), F.col(x))

    kept = F.when(F.col("none"), F.col("row") == F.col("end.row")).otherwise(F.col("vec_id") == F.col("end.vec_id"))
    return done.select(name("vec_id", "none").alias("vec_id"), "n_links", name("end.vec_id", "end.none").alias("component_id"), kept.alias("kept"))
