"""Buckets of rows that share a key, and their comparison in blocks inside tasks."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import find_roots, released, stored
from quarrykit.llm.shingles import signature

#: MinHash values looked at before pairs are pruned again, and the posterior probability below which they are.
STEP, TOLERANCE = 20, 1e-9
#: So few sets are compared as they are.
FEW = 8

#: Rows, and bytes of what is compared, of one block; larger groups are compared block by block.
BLOCK, BLOCK_BYTES = 1024, 2**24
#: Rows, and bytes, of small groups that are put together into one task's group.
CELL, CELL_BYTES = 2048, 2**24
#: Rows, and small elements of arrays, up to which a stored table is broadcast.
BROADCAST_ROWS, BROADCAST_ELEMENTS = 500_000, 2_000_000

#: Linked pairs (a of ``left``, b of ``right`` or, if that is None, b of ``left`` too) of rows by place.
Linked = Callable[[np.ndarray, "np.ndarray | None"], tuple[np.ndarray, np.ndarray]]


def least_matches(threshold: float, n_hashes: int, step: int = STEP, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After t values, the fewest matches with which a pair may still reach the threshold.

    With a flat prior, m matches of t give the similarity a Beta(m + 1, t - m + 1) posterior; its mass above the
    threshold is the chance that a binomial of t + 1 trials with that probability has at most m successes.
    """
    out = {}
    for t in range(step, n_hashes + 1, step):
        mass = 0.0
        for m in range(t + 1):
            mass += comb(t + 1, m) * threshold**m * (1 - threshold) ** (t + 1 - m)
            if mass >= tolerance:
                out[t] = m
                break
    return out


def candidate_pairs(sigs: np.ndarray, others: np.ndarray | None, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (within ``sigs``, or between it and ``others``) that no comparison of values has ruled out."""
    same = others is None
    right = sigs if same else others
    i = j = matches = None
    done = 0
    for t, fewest in sorted(least.items()):
        if i is None:
            count = np.zeros((len(sigs), len(right)), dtype=np.uint8)
            for k in range(done, t):
                count += sigs[:, k, None] == right[None, :, k]
            open_ = count >= fewest
            i, j = np.nonzero(np.triu(open_, 1) if same else open_)
            matches = count[i, j].astype(np.int32)
        else:
            for lo in range(0, len(i), 2**18):
                part = slice(lo, lo + 2**18)
                matches[part] += (sigs[i[part], done:t] == right[j[part], done:t]).sum(axis=1)
            open_ = matches >= fewest
            i, j, matches = i[open_], j[open_], matches[open_]
        done = t
        if not len(i):
            break
    return i, j


def intersections(sets: list[np.ndarray], others: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact numbers of shared shingles for pairs (i of ``sets``, j of ``others``)."""
    if len(i) <= 4 * (len(sets) + len(others)):
        return np.array([_shared(sets[a], others[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    left, right = np.unique(i), np.unique(j)
    whole = np.concatenate([sets[a] for a in left] + [others[b] for b in right])
    vocabulary, seen = np.unique(whole, return_counts=True)
    vocabulary = vocabulary[seen > 1]
    totals = np.zeros((len(left), len(right)), dtype=np.int64)
    for lo in range(0, len(vocabulary), 4096):
        part = vocabulary[lo : lo + 4096]
        totals += (_incidence([sets[a] for a in left], part) @ _incidence([others[b] for b in right], part).T).astype(np.int64)
    return totals[np.searchsorted(left, i), np.searchsorted(right, j)]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _incidence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(vocabulary)), dtype=np.float32)
    for k, own in enumerate(sets):
        lo, hi = np.searchsorted(own, vocabulary[0]), np.searchsorted(own, vocabulary[-1], side="right")
        at = np.searchsorted(vocabulary, own[lo:hi])
        out[k, at[vocabulary[at] == own[lo:hi]]] = 1
    return out


def at_most(df: DataFrame, rows: int = BROADCAST_ROWS, of: Column | None = None) -> DataFrame:
    """``df`` (stored), marked for a broadcast if it has ``rows`` rows at most and, if ``of`` says how many a row has, ``BROADCAST_ELEMENTS`` elements."""
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.lit(0) if of is None else of), F.lit(0)).alias("of")).first()
    return F.broadcast(df) if total["n"] <= rows and total["of"] <= BROADCAST_ELEMENTS else df


def shared_buckets(keys: DataFrame) -> DataFrame:
    """Of rows (``key``, ``node``; repeats do no harm), those whose key two nodes and more have: stored rows (``bucket``, ``node``).

    Keys that the very same nodes have are one bucket.
    """
    several = stored(keys.groupBy("key").count().where("count > 1").select("key"), "shared")
    members = stored(keys.join(several, "key").select("key", "node").distinct(), "members")
    nodes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("all_"))
    alike = stored(nodes.where("n > 1").groupBy("n", "low", "high", "all_").agg(F.min("key").alias("key")).select("key"), "alike")
    found = stored(members.join(alike, "key").select(F.col("key").alias("bucket"), "node"), "buckets")
    released(several, members, alike)
    return found


def _forest_pairs(m: int, linked: Linked, sides: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs enough to join all that links join: rows linked with the first one are compared with the others only."""
    first, rest = np.array([0]), np.arange(1, m)
    a, b = linked(first, rest)
    near = np.zeros(m, dtype=bool)
    near[0] = near[b] = True
    parts = [(a, b)]
    far, near = np.flatnonzero(~near), np.flatnonzero(near)
    if sides is None:
        parts += [linked(far, None), linked(near, far)]
    else:
        left, right = sides
        parts += [linked(np.intersect1d(left, far), right), linked(np.intersect1d(left, near), np.intersect1d(right, far))]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def first_shared(linked: Linked, keys: np.ndarray, own: int) -> Linked:
    """``linked`` without the pairs that share a smaller key than ``own``; ``keys`` has a row of keys for each row."""
    early = keys < own

    def first(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        a, b = linked(left, right)
        hit = np.ones(len(a), dtype=bool)
        for lo in range(0, len(a), 2**14):
            x, y = a[lo : lo + 2**14], b[lo : lo + 2**14]
            hit[lo : lo + 2**14] = ~((keys[x] == keys[y]) & early[x]).any(axis=1)
        return a[hit], b[hit]

    return first


def _compare(make: Callable[[list[bytes]], Linked], count: bool, keyed: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    names = ("node", "links", "to", "root") if keyed else ("node", "links", "to")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        out = []
        cell = cell.sort_values(["root", "i", "j", "node"], kind="stable").drop_duplicates(["root", "i", "j", "node"])
        nodes, weights, blocks, i, j, roots = (cell[x].to_numpy() for x in ("node", "weight", "block", "i", "j", "root"))
        values = cell.value.tolist()
        ends = np.flatnonzero((np.diff(roots) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(cell)], strict=True):
            node, weight, block = nodes[lo:hi], weights[lo:hi], blocks[lo:hi]
            sides = None if i[lo] == j[lo] else (np.flatnonzero(block == i[lo]), np.flatnonzero(block == j[lo]))
            if hi - lo < 2 or sides is not None and not (len(sides[0]) and len(sides[1])):
                continue
            linked = make(values[lo:hi])
            if keyed:
                linked = first_shared(linked, np.stack(cell["keys"].iloc[lo:hi].to_list()), roots[lo])
            if not count:
                a, b = _forest_pairs(len(node), linked, sides)
            elif sides is None:
                a, b = linked(np.arange(len(node)), None)
            else:
                a, b = linked(*sides)
            if not len(a):
                continue
            links = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
            to = node[find_roots(a, b, len(node))]  # nodes are in order
            hit = links > 0
            out.append((node[hit], links[hit].astype(np.int64), to[hit], np.full(hit.sum(), roots[lo])))
        return pd.DataFrame({x: np.concatenate([y[k] for y in out]) if out else np.zeros(0, np.int64) for k, x in enumerate(names)})

    return compare


def block_count(size: Column, n_bytes: Column, block: int | None = None) -> Column:
    """The blocks that a group of so many rows and bytes is dealt to."""
    return F.ceil(F.greatest(size / (block or BLOCK), n_bytes / BLOCK_BYTES)).cast("int")


def compare_groups(rows: DataFrame, make: Callable[[list[bytes]], Linked], count: bool = True, block: int | None = None) -> DataFrame:
    """Compares the rows (``node``, ``root``, ``weight``, ``value`` binary) of each group ``root`` with each other.

    ``make`` gets values and returns the function that finds their linked pairs. Returns stored rows (``node``, ``links``, ``to``): a
    forest of the links and, with ``count``, the weights linked with a node; a node may have a row for each block it was in. A
    node that comes twice in a group counts once. Rows of a
    large group are dealt to blocks by a hash, and each block meets each other; small groups share a task's group. Blocks
    and cells are bounded by rows and by bytes, so what a task holds doesn't grow with the input. Without ``count`` not every pair
    is compared, as what is linked with a group's first row needn't be compared among itself.

    Rows with a column ``keys`` (longs, as many for each row) may be in several groups, each known by a key that its rows share: a pair
    counts only in the group of the smallest key it shares, and the result says by ``root`` which group a row is of.
    """
    keyed = "keys" in rows.columns
    rows = stored(rows, "compared")
    size = F.length("value")
    sizes = rows.groupBy("root").agg(F.count("*").alias("size"), F.sum(size).alias("bytes"))
    blocks = block_count(F.col("size"), F.col("bytes"), block)
    sizes = stored(sizes.where("size > 1").select("root", blocks.alias("blocks")), "sizes")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    cells = max(1, -(-total["n"] // CELL), -(-total["bytes"] // CELL_BYTES))
    dealt = rows.join(at_most(sizes), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", "root", "weight", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "value", "blocks", *(["keys"] if keyed else []))
    cell: Column = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(cells))).otherwise(F.xxhash64("root", "i", "j"))
    found = met.withColumn("cell", cell).groupBy(F.col("blocks") == 1, "cell").applyInPandas(_compare(make, count, keyed), "node long, links long, to long" + ", root long" * keyed)
    found = stored(found, "links")
    released(rows, sizes)
    return found


def set_links(threshold: float, factors: np.ndarray) -> Callable[[list[bytes]], Linked]:
    """For ``compare_groups`` of sets (sorted 64-bit hashes): MinHash values rule out most pairs step by step, whole sets decide."""
    least = least_matches(threshold, len(factors))
    ratio = Fraction(str(threshold))

    def make(values: list[bytes]) -> Linked:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in values]
        lens = np.array([len(x) for x in sets], dtype=np.int64)
        sigs = np.array([signature(x, factors) for x in sets]) if len(sets) > FEW else None

        def linked(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            if sigs is None:
                a, b = np.triu_indices(len(left), 1) if right is None else (np.repeat(np.arange(len(left)), len(right)), np.tile(np.arange(len(right)), len(left)))
            else:
                a, b = candidate_pairs(sigs[left], None if right is None else sigs[right], least)
            a, b = left[a], (left if right is None else right)[b]
            common = intersections(sets, sets, a, b)
            hit = common * ratio.denominator >= ratio.numerator * (lens[a] + lens[b] - common)
            return a[hit], b[hit]

        return linked

    return make


def likely_links(threshold: float, n_hashes: int) -> Callable[[list[bytes]], Linked]:
    """For ``compare_groups`` of MinHash signatures cut to a byte a value: pairs that may reach the threshold, by posterior probability."""
    least = least_matches(threshold, n_hashes)

    def make(values: list[bytes]) -> Linked:
        sigs = np.stack([np.frombuffer(x, dtype=np.uint8) for x in values])

        def linked(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            a, b = candidate_pairs(sigs[left], None if right is None else sigs[right], least)
            return left[a], (left if right is None else right)[b]

        return linked

    return make
