"""Removal of passages that repeat within or across documents, found by keys of paragraphs.

A paragraph here is a line. Lines meet by bands of MinHash values, so near copies of a line are found. What repeats word by word is found
wherever lines break: of all runs of ``RUN`` words that start in a window, the one with the smallest hash is an anchor, and windows are as wide
as makes every string of ``passage`` words hold one. Anchors meet together with the words up to the next anchor and its end, or alone, and the
ends of a passage are found by comparing words with the kept copy.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.buckets import at_most, compare_groups, set_links, shared_buckets
from quarrykit.llm.common import components, released, stored
from quarrykit.llm.shingles import band_keys_of, mixed, multipliers, run_hashes, shingle_set, slices_of, word_bounds, word_hashes

WIDTH, THRESHOLD = 5, 0.8
#: Fewest words of a line that is compared as a line.
LEAST = 5
#: Words of the runs that anchors are. Each string of as many words as a passage has holds one.
RUN = 8
#: Words of neighbouring repeated paragraphs that make a passage. Documents that repeat as a whole are passages of any length.
PASSAGE = 22
#: Larger sets: at similarity 0.8, all bands differ with probability (1 - 0.8^2)^14, below 1e-6.
BANDS, ROWS = 14, 2
#: Sets of up to so many shingles have keys that none of their links can miss.
SMALL = 14
#: Lines that a task remembers; an equal one has no keys of its own.
REMEMBERED = 2**20
#: Neighbouring anchors with one hash beyond which some are left out: text that repeats a few words over and over.
TIED = 32
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


#: Kinds of units: a run of words and those up to the end of the next one, a line, a text of fewer words than a passage.
ANCHOR, LINE, WHOLE = 0, 1, 2


@dataclass(frozen=True)
class Words:
    """Words of some texts, one text after another: hashes (if asked for), starts and ends (bytes of ``data``), and each text's offset in ``data``, first word and number of words."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offset: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leads: np.ndarray  # first word of each line that has words


def words_of(texts: list[np.ndarray], hashed: bool = True) -> Words:
    line_break = np.array([10], dtype=np.uint8)
    data = np.concatenate([x for t in texts for x in (t, line_break)]) if texts else np.zeros(0, np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    offset = np.cumsum(sizes) - sizes
    starts, ends = word_bounds(data)
    first = np.searchsorted(starts, offset)
    count = np.diff(np.r_[first, len(starts)])
    hashes, leads = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if hashed and len(starts):
        lines = np.searchsorted(np.flatnonzero(data == 10), starts)
        leads = np.flatnonzero(np.r_[True, lines[1:] != lines[:-1]])
        hashes = word_hashes(data, (starts, ends))
    return Words(data, hashes, starts, ends, offset, first, count, leads)


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """Place of the (first) smallest of the ``window`` values from each place on."""
    at, size = np.arange(len(values)), 1
    while size < window:
        step = min(size, window - size)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at


def _untied(at: np.ndarray, values: np.ndarray, step: int) -> np.ndarray:
    """``at`` without most of each long chain of places less than ``step`` apart that have one value: the first in each ``step`` places stays, and the last of all."""
    if len(at) < TIED:
        return at
    tied = np.r_[False, (values[at[1:]] == values[at[:-1]]) & (at[1:] - at[:-1] < step)]
    chain = np.cumsum(~tied) - 1
    part = (at - at[~tied][chain]) // step
    again = tied & np.r_[False, part[1:] == part[:-1]] & np.r_[chain[1:] == chain[:-1], False] & (np.bincount(chain)[chain] > TIED)
    return at[~again]


def anchors(runs: np.ndarray, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Places of anchors among ``runs``, of which each text has ``count`` from ``first`` on: the smallest of each ``window`` neighbours, or of all if there are fewer."""
    n = np.maximum(count - window + 1, 0)
    at = _least(runs, window)[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    few = np.flatnonzero((count > 0) & (count < window))
    if len(few):
        place = np.arange(window - 1)
        inside = place < count[few, None]
        found = np.where(inside, runs[np.where(inside, first[few, None] + place, first[few, None])], np.uint64(2**64 - 1))
        at = np.r_[at, first[few] + found.argmin(axis=1)]
    return _untied(np.unique(at), runs, max(1, (window + 1) // 2))


@dataclass(frozen=True)
class Units:
    """What is compared: text, kind, first word among all, words, and two hashes of them (an anchor's: of its run, and of all its words)."""

    text: np.ndarray
    kind: np.ndarray
    first_word: np.ndarray
    n_words: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


def units(found: Words, shingles: np.ndarray, passage: int) -> Units:
    run = min(RUN, passage)
    # two shingles say all words of a run
    runs = run_hashes(found.hashes, run) if run <= WIDTH else mixed(mixed(shingles[: WIDTH - run or None]) + shingles[run - WIDTH :])
    at = anchors(runs, found.first, np.maximum(found.count - run + 1, 0), passage - run + 1)
    owner = np.repeat(np.arange(len(found.count)), found.count)
    after = np.r_[at[1:], at[-1:]]
    reach = np.where(owner[after] == owner[at], after - at, 0) + run
    width = min(WIDTH, run)
    own = shingles if width == WIDTH else run_hashes(found.hashes, width)
    sums = mixed(_over(mixed(own), at, reach - width + 1, np.add) + reach.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
    size = np.diff(np.r_[found.leads, len(found.hashes)])
    lead, size = found.leads[size >= LEAST], size[size >= LEAST]
    short = np.flatnonzero((found.count > 0) & (found.count < passage))
    first, n_words = np.r_[lead, found.first[short]], np.r_[size, found.count[short]]
    h1, h2 = _sums(found.hashes, shingles, first, n_words)
    kind = np.repeat([ANCHOR, LINE, WHOLE], [len(at), len(lead), len(short)])
    return Units(np.r_[owner[at], owner[first]], kind, np.r_[at, first], np.r_[reach, n_words], np.r_[runs[at], h1], np.r_[sums, h2])


def _over(values: np.ndarray, first: np.ndarray, count: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
    """``ufunc`` over ``count`` values from ``first`` on, for each."""
    spans = np.stack([first, first + count], axis=1).reshape(-1)
    return ufunc.reduceat(np.r_[values, values[-1:]], spans)[::2]


def _sums(hashes: np.ndarray, runs: np.ndarray, first: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the shingles of ``n_words`` words from ``first`` on, for each; fewer words than ``WIDTH`` are one shingle."""
    sums = np.empty((2, len(first)), dtype=np.uint64)
    long = np.flatnonzero(n_words >= WIDTH)
    for k in (0, 1):
        if len(long):
            sums[k, long] = _over(mixed(runs + np.uint64(k)), first[long], n_words[long] - WIDTH + 1, np.add)
        for at in np.flatnonzero(n_words < WIDTH).tolist():
            words = hashes[first[at] : first[at] + n_words[at]]
            sums[k, at] = mixed(run_hashes(words, len(words)) + np.uint64(k))[0]
    return sums[0], sums[1]


def _document_key(id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _set_keys(sets: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of sets of one size (sorted rows): pairs among the smallest shingles. Sets at ``threshold`` and above share one.

    Of n shingles ceil(threshold * n) are shared at least, so the smallest two shared ones are among the first n - ceil(threshold * n) + 2.
    """
    n = sets.shape[1]
    first = min(n, n - math.ceil(threshold * n - 1e-9) + 2)
    pairs = list(combinations(range(first), 2)) if n > 1 else [(0, 0)]
    return np.stack([mixed(mixed(sets[:, i] + np.uint64(77)) + sets[:, j]) for i, j in pairs], axis=1)


def unit_keys(runs: np.ndarray, first: np.ndarray, count: np.ndarray, threshold: float, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (and the unit of each) that units of ``count`` runs from ``first`` on share if they are linked: exactly up to ``SMALL`` shingles, by bands beyond."""
    who, keys = [], []

    def add(own: np.ndarray, found: np.ndarray) -> None:
        who.append(np.repeat(own, found.shape[1]))
        keys.append(found.reshape(-1))

    sized: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for c in np.unique(count[count <= SMALL]).tolist():
        own = np.flatnonzero(count == c)
        sets = np.sort(runs[first[own, None] + np.arange(c)], axis=1)
        again = (sets[:, 1:] == sets[:, :-1]).any(axis=1)
        sized.setdefault(c, []).append((own[~again], sets[~again]))
        for k in np.flatnonzero(again):
            part = np.unique(sets[k])
            sized.setdefault(len(part), []).append((own[k : k + 1], part[None]))
    for k in np.flatnonzero(count > SMALL):
        part = np.unique(runs[first[k] : first[k] + count[k]])
        if len(part) <= SMALL:
            sized.setdefault(len(part), []).append((np.array([k]), part[None]))
    for parts in sized.values():
        add(np.concatenate([x for x, _ in parts]), _set_keys(np.concatenate([x for _, x in parts]), threshold))
    # a larger set's links have this many shingles at least, and runs
    own = np.flatnonzero(count >= math.floor(threshold * SMALL))
    if len(own):
        sigs = np.stack([_over(runs * f, first[own], count[own], np.minimum) for f in factors], axis=1) >> np.uint64(32)
        add(own, band_keys_of(sigs, BANDS))
    return (np.concatenate(who), np.concatenate(keys)) if who else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


_UNITS = "doc_id long, key long, kind int, word int, words int, h1 long, h2 long, start int, stop int, keys array<long>"


def _units(threshold: float, passage: int) -> object:
    names = [x.split()[0] for x in _UNITS.split(", ")]
    factors = multipliers(BANDS * ROWS, seed=9)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for begin, texts in slices_of(batch["text"]):
                found = words_of(texts)
                runs = run_hashes(found.hashes, WIDTH)
                own = units(found, runs, passage)
                if not len(own.text):
                    continue
                lined = []
                is_line = own.kind == LINE
                for k, h in zip(np.flatnonzero(is_line).tolist(), own.h1[is_line].tolist(), strict=True):
                    if h not in seen:
                        seen.add(h)
                        lined.append(k)
                if len(seen) > REMEMBERED:
                    seen.clear()
                lined = np.array(lined, dtype=np.int64)
                who, key = unit_keys(runs, own.first_word[lined], own.n_words[lined] - WIDTH + 1, threshold, factors)
                order = np.lexsort((key, who))
                who, key = lined[who[order]], key[order]
                new = np.r_[True, (who[1:] != who[:-1]) | (key[1:] != key[:-1])] if len(who) else np.zeros(0, bool)
                who, key = who[new], key[new]
                offsets = np.r_[0, np.cumsum(np.bincount(who, minlength=len(own.text)))]
                taken = pa.array(begin + own.text)
                start, stop = found.starts[own.first_word] - found.offset[own.text], found.ends[own.first_word + own.n_words - 1] - found.offset[own.text]
                columns = [
                    batch["doc_id"].take(taken), batch["key"].take(taken), pa.array(own.kind, pa.int32()), pa.array(own.first_word - found.first[own.text], pa.int32()), pa.array(own.n_words, pa.int32()),
                    pa.array(own.h1.view(np.int64)), pa.array(own.h2.view(np.int64)), pa.array(start, pa.int32(), mask=~is_line), pa.array(stop, pa.int32(), mask=~is_line),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key.view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return find


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the wanted lines (``found``: node, start, stop) of each text; once in a task for rows that are equal in id and text."""
    seen: set[int] = set()
    for batch in batches:
        for begin, texts in slices_of(batch["text"]):
            node, sets = [], []
            for text, lines in zip(texts, batch["found"].slice(begin, len(texts)).to_pylist(), strict=True):
                if lines[0]["node"] not in seen:
                    seen.add(lines[0]["node"])
                    node += [x["node"] for x in lines]
                    sets += [shingle_set(text[x["start"] : x["stop"]], WIDTH).tobytes() for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], names=["node", "value"])


_SIDES = "doc_id long, key long, word int, until int, total long, start long, stop long, before binary, after binary"


def _sides(beside: int) -> object:
    """Place, and the bytes of ``beside`` words to each side, of the wanted words (``found``: ``word`` up to ``until``); and their texts' words.

    Had more words than a passage has been the same beyond an end, they would hold an anchor of their own.
    """
    names = [x.split()[0] for x in _SIDES.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices_of(batch["text"]):
                lists = batch["found"].slice(begin, len(texts))
                row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                word, until = (pc.struct_field(lists.flatten(), x) for x in ("word", "until"))
                found = words_of(texts, hashed=False)
                first, total = found.first[row], found.count[row]
                place, end = word.to_numpy(), until.to_numpy()
                start, stop = found.starts[first + place], found.ends[first + end - 1]
                left, right = found.starts[first + np.maximum(0, place - beside)], found.ends[first + np.minimum(total, end + beside) - 1]
                cut = [(found.data[a:b].tobytes(), found.data[c:d].tobytes()) for a, b, c, d in zip(*(x.tolist() for x in (left, start, stop, right)), strict=True)]
                taken = pa.array(begin + row)
                own = (total, start - found.offset[row], stop - found.offset[row])
                columns = [batch["doc_id"].take(taken), batch["key"].take(taken), word, until, *(pa.array(x, pa.int64()) for x in own), *(pa.array([x[k] for x in cut], pa.binary()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return find


_GROWN = "doc_id long, key long, total long, word long, until long, start long, stop long, kept_doc_id long"


def _grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the words next to an end that are the same next to its kept copy. ``left`` and ``right`` say which ends to look at."""
    for batch in batches:
        grown = []
        for left, right, before, after, kept_before, kept_after, word, until, start, stop in zip(*(batch[x] for x in ("left", "right", "before", "after", "kept_before", "kept_after", "word", "until", "start", "stop")), strict=True):
            n = sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(reversed(before.split()), reversed(kept_before.split()), strict=False))) if left else 0
            m = sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(after.split(), kept_after.split(), strict=False))) if right else 0
            if n:
                start += [x.start() for x in _WORD.finditer(before)][-n] - len(before)
            if m:
                stop += [x.end() for x, _ in zip(_WORD.finditer(after), range(m), strict=False)][-1]
            grown.append((word - n, until + m, start, stop))
        out = pd.DataFrame(grown, columns=["word", "until", "start", "stop"], index=batch.index, dtype="int64")
        yield pd.concat([batch[["doc_id", "key", "total", "kept_doc_id"]], out], axis=1)[[x.split()[0] for x in _GROWN.split(", ")]]


_DOC = ("doc_id", "key")


def _same_doc(a: DataFrame, b: DataFrame) -> F.Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])


def _islands(spans: DataFrame) -> DataFrame:
    """Numbers the runs of spans (``word`` up to ``until``) of each document that touch: ``island``."""
    own = Window.partitionBy(*_DOC).orderBy("word", F.desc("until"))
    before = F.max("until").over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(before >= F.col("word"), 0).otherwise(1).cast("long"))
    return new.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def _line_roots(rows: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """``h1``, ``h2`` and ``root`` of the lines with near copies: components of links of ``threshold`` and above.

    A node is ``h1``, so equal lines are one and are compared once. Should two lines have one ``h1``, only that with the ``h2`` of
    the line that was compared is in a component.
    """
    lines = found.where("start IS NOT NULL")
    met = shared_buckets(lines.select(F.col("h1").alias("node"), F.explode("keys").alias("key")))
    nodes = stored(met.select("node").distinct(), "nodes")
    place = F.struct("h2", *_DOC, "start", "stop")
    reps = lines.join(at_most(nodes), lines["h1"] == nodes["node"]).groupBy("node").agg(F.min(place).alias("at"))
    reps = stored(reps.select("node", "at.*"), "reps")
    by_doc = stored(reps.groupBy(*_DOC).agg(F.collect_list(F.struct("node", "start", "stop")).alias("found")), "wanted")
    wanted = at_most(by_doc, of=F.size("found"))
    sets = stored(rows.join(wanted, _same_doc(rows, wanted)).select("found", rows["text"]).mapInArrow(_sets, "node long, value binary"), "sets")
    factors = multipliers(BANDS * ROWS, seed=9)
    links = compare_groups(met.join(sets, "node").select("node", F.col("bucket").alias("root"), F.lit(1).cast("long").alias("weight"), "value"), set_links(threshold, factors), count=False)
    roots = components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    named = stored(reps.join(roots, "node").select(F.col("node").alias("h1"), "h2", "root"), "roots")
    released(met, nodes, reps, by_doc, sets, links)
    return named


def _first(members: DataFrame, group: list[str]) -> DataFrame:
    """The first member (nulls last) of each group, as ``kept_`` columns, and the group's size ``n``."""
    spot = [*_DOC, "word", "until"]
    first = F.struct(F.col("doc_id").isNull().alias("none"), *spot)  # the flag before the id
    heads = members.groupBy(*group).agg(F.min(first).alias("head"), F.count("*").alias("n"))
    return heads.select(*group, "n", *(F.col(f"head.{x}").alias(f"kept_{x}") for x in spot))


def _itself() -> F.Column:
    return F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("key") == F.col("kept_key")) & (F.col("word") == F.col("kept_word")) & (F.col("until") == F.col("kept_until"))


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of documents that repeat earlier ones: one row for each that is to be removed.

    Lines whose sets of 5-word shingles have a Jaccard similarity of ``threshold`` or more are linked, and so are equal lines, equal texts of
    fewer than ``passage`` words and equal anchors (see this module). In each component of links the first (smallest document, then place) stays
    and the others go, with the words beside them that are also beside the one that stays, if what touches has ``passage`` words together or is
    a whole document. Returns ``key`` (a hash of a document's id and text), ``doc_id``, ``start``, ``stop`` (bytes of the UTF-8 text),
    ``n_words``, ``n_paragraphs`` (lines and anchors in it) and ``kept_doc_ids`` (documents that keep what goes here, in order).

    Keys only propose: lines that share one are compared as whole sets inside tasks, and a bucket hands on a forest of its links.
    A passage that changes a fifth of the shingles of each line it is in is found by the words that are left. A passage that holds one anchor
    alone is compared with the first place of that anchor's run; it is missed if another document has the run earlier without the rest.

    Null texts and texts without words have no passages. Null ids come after all others. Rows with
    the same id and text are one document; rows with the same or no id and other texts are documents of their own.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", _document_key("doc_id", "text"))
    found = stored(rows.select("doc_id", "key", "text").mapInArrow(_units(threshold, passage), _UNITS), "units")
    roots = _line_roots(rows, found, threshold)
    plain = found.select(*_DOC, "kind", "word", "words", "h1", "h2")
    copies = plain.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1")
    wanted = stored(copies.unionByName(roots.select("h1")).distinct(), "wanted")
    members = stored(plain.join(wanted, "h1"), "members")
    released(found, wanted)
    # a group is a component of lines (its root), or a class of equal units (their hashes)
    near = F.col("root").isNotNull()
    members = members.join(at_most(roots), ["h1", "h2"], "left").select(
        *_DOC, "word", (F.col("word") + F.col("words")).alias("until"), (F.col("kind") == ANCHOR).alias("anchor"), near.alias("near"),
        F.coalesce("root", "h1").alias("g1"), F.when(near, 0).otherwise(F.col("h2")).alias("g2"),
    )
    group = ["anchor", "near", "g1", "g2"]
    spot = [*_DOC, "word", "until"]
    heads = stored(_first(members, group).where("n > 1 OR anchor"), "heads")
    gone = members.join(heads.where("n > 1"), group).where(~_itself()).select(*spot, *(f"kept_{x}" for x in spot))
    # anchors that go on in different ways: the first of each way has the first of all to compare with
    run = min(RUN, passage)
    ways = heads.where("anchor").select("g1", *(F.col(f"kept_{x}").alias(x) for x in _DOC), F.col("kept_word").alias("word"), (F.col("kept_word") + run).alias("until"))
    firsts = stored(_first(ways, ["g1"]).where("n > 1"), "firsts")
    others = ways.join(firsts, "g1").where(~_itself()).select(*spot, *(f"kept_{x}" for x in spot))
    kept = F.struct(F.col("kept_doc_id").isNull().alias("none"), *(f"kept_{x}" for x in spot))
    gone = gone.unionByName(others).groupBy(*spot).agg(F.min(kept).alias("kept")).select(*spot, *(f"kept.kept_{x}" for x in spot))
    # the ends of islands, and what is beside them and beside the kept copies
    own = Window.partitionBy(*_DOC, "island")
    ends = _islands(gone)
    ends = ends.withColumn("left", F.row_number().over(own.orderBy("word", F.desc("until"))) == 1).withColumn("right", F.row_number().over(own.orderBy(F.desc("until"), "word")) == 1)
    ends = stored(ends, "gone")
    released(heads, firsts)
    outer = ends.where("left OR right")
    beside = outer.select(*spot).unionByName(outer.select(*(F.col(f"kept_{x}").alias(x) for x in spot)))
    beside = stored(beside.groupBy(*_DOC).agg(F.collect_set(F.struct("word", "until")).alias("found")), "beside")
    wanted = at_most(beside, of=F.size("found"))
    sides = rows.join(wanted, _same_doc(rows, wanted)).select(rows["doc_id"], rows["key"], rows["text"], "found").mapInArrow(_sides(passage), _SIDES)
    sides = stored(sides, "sides")  # rows that are equal in id and text give equal rows here, and again below
    kept = sides.select(*(F.col(x).alias(f"kept_{x}") for x in (*spot, "before", "after"))).dropDuplicates([f"kept_{x}" for x in spot])
    near = outer.alias("e").join(sides.dropDuplicates(spot).alias("s"), F.expr("e.doc_id <=> s.doc_id AND e.key = s.key AND e.word = s.word AND e.until = s.until")).select("e.*", "s.total", "s.start", "s.stop", "s.before", "s.after")
    near = near.alias("e").join(kept.alias("k"), F.expr("e.kept_doc_id <=> k.kept_doc_id AND e.kept_key = k.kept_key AND e.kept_word = k.kept_word AND e.kept_until = k.kept_until")).select("e.*", "k.kept_before", "k.kept_after")
    none = F.lit(None).cast("long")
    inner = ends.where("NOT left AND NOT right").select(*_DOC, none.alias("total"), "word", "until", none.alias("start"), none.alias("stop"), "kept_doc_id")
    found = _islands(near.mapInPandas(_grow, _GROWN).unionByName(inner)).groupBy(*_DOC, "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("until") - F.min("word")).alias("n_words"), F.count("*").alias("n_paragraphs"),
        F.array_sort(F.collect_set("kept_doc_id")).alias("kept_doc_ids"), F.max("total").alias("total"),
    )
    return found.where((F.col("n_words") >= passage) | (F.col("n_words") == F.col("total"))).drop("island", "total")


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages; a document without any is unchanged."""
    spans = passages.groupBy(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans_: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans_, strict=True):
            if t is not None and own is not None:
                raw = t.encode("utf-8", "replace")
                for x in sorted(own, key=lambda y: -y["start"]):
                    raw = raw[: x["start"]] + raw[x["stop"] :]
                t = raw.decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    same = (_document_key(id_col, text_col) == F.col("_key")) & F.col(id_col).cast("long").eqNullSafe(F.col("_doc_id"))
    joined = docs.join(spans, same, "left")
    return joined.withColumn(text_col, cut(text_col, "_spans")).select(docs.columns)
