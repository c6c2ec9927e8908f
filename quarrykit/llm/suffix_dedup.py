"""Removal of long byte strings that repeat across documents, by sorted suffixes of candidate texts.

No text is compared that can't repeat. Every window of ``length`` bytes has an anchor, the string of ``ANCHOR`` bytes in it
with the smallest hash; equal windows have equal anchors at equal places. Documents are shuffled once, into chunks; what
follows reads that shuffle again and sends small messages between chunks and buckets:

1. chunks -> buckets: hashes of anchors and of whole texts;
2. buckets -> chunks: a bit for each, whether another document has the anchor, or one with a smaller id the whole text;
3. chunks -> buckets: hashes of the texts around shared anchors, once a chunk for all copies (classes);
4. buckets -> chunks: a bit for each, whether this chunk is to send the text; one chunk is for each class;
5. chunks -> buckets: these texts; there all windows of texts that share an anchor are sorted (``suffix_sort``), and the
   smallest document with each window is found;
6. buckets -> chunks: that document for each class; chunks mark and remove what they hold again.

Messages of steps 2, 4, 5 and 6 name nothing: they follow the order of the list that they answer, which both sides can make again
and which a sum vouches for. A document whose whole text one with a smaller id has goes whole, and takes no part from step 3 on.

A chunk is a hash share of the documents, a bucket a hash share of anchors; both are as many as shuffle partitions. A string
that very many documents hold costs one entry a chunk, and its text goes once. A phrase that very many documents hold in differing surroundings would
be an anchor of more texts than a task should sort. Buckets name such crowded anchors in step 2, and their windows go to buckets
by the bytes around the anchor that windows with it in about the same place share (all but 7 of a window's): each window to one
bucket, equal windows to the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrykit.llm.common import partitions
from quarrykit.llm.suffix_sort import sort_windows, words

ANCHOR = 20
#: Places of a window around a crowded anchor that go to one bucket together.
STEP = 8
#: Bytes of text that a task looks at together, and holds before it deals them to chunks.
SLICE, HELD = 2**20, 2**25
#: Bits of a place in a slice, which has less than 2 * SLICE + 2 * length bytes. The same for all slices, so that equal windows choose equal anchors.
PLACE_BITS = 22
#: Windows that are sorted together.
SORTED = 2**20
NULL_ID = -(2**63)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_PART = pa.schema([("to", pa.int32()), ("sender", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_PART_SQL = "to int, sender int, kind int, blob binary"
_DOCS, _ANCHORS, _WHOLE, _SHARED, _COPIES, _CLASSES, _WANTED, _TEXTS, _FOUND = range(9)
#: Of an anchor's hash the bucket gets the lower half, as the upper one decides the bucket.
_HALF = np.uint64(32)
#: As the last window of a stretch: the last of its text.
_LAST = np.uint8(255)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x *= _K[k]
    x ^= x >> np.uint64(29)
    return x


def _hash(text_words: np.ndarray, at: np.ndarray | slice, n_bytes: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ``n_bytes`` from each place on; whole characters only, the last one overlaps the one before."""
    steps = [*range(0, n_bytes - 8, 8), n_bytes - 8]
    n = len(text_words) - n_bytes

    def take(step: int) -> np.ndarray:
        return text_words[step : step + n] if isinstance(at, slice) else text_words[at + step]

    h = _mixed(take(0) ^ np.uint64(seed), 0)
    for k, step in enumerate(steps[1:]):
        h += take(step)
        _mixed(h, 1 + k % 3)
    h ^= h >> np.uint64(32)
    return _mixed(h, 3)


def _columns(batch: pa.RecordBatch | pa.Table, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, all text bytes and each text's bounds (one more than texts)."""
    ids = pc.fill_null(batch[id_col].cast(pa.int64()), NULL_ID)
    text = batch[text_col].cast(pa.large_string())
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks)
    text = pc.fill_null(text, "")
    bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if len(text) and text.buffers()[2] else np.zeros(0, np.uint8)
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return ids.to_numpy(zero_copy_only=False), data, bounds


def _slices(bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of text of about ``SLICE`` bytes: from, to, and the first and last window starts that they answer for.

    A longer text is cut in overlapping stretches, each window in one of them.
    """
    lo = 0
    n = len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE, side="right")) - 1)
        first, end = bounds[lo:hi], bounds[lo + 1 : hi + 1]
        if hi == lo + 1 and end[0] - first[0] > 2 * SLICE:
            for start in range(int(first[0]), int(end[0]) - length + 1, SLICE):
                last = min(start + SLICE - 1, int(end[0]) - length)
                yield start, last + length, np.array([start]), np.array([last])
        else:
            yield int(first[0]), int(end[-1]), first, end - length
        lo = hi


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows with the same anchor in a row, slice by slice: anchor hash, first window, windows, anchor's place in the first; and the slice's characters from byte 0 of ``data`` on (as a view to index with places less the slice's start)."""
    wide = length - ANCHOR + 1
    for start, stop, first, last in _slices(bounds, length):
        n = stop - start
        if n < length:
            continue
        raw = np.zeros(n + 2 * length + 16, dtype=np.uint8)
        raw[:n] = data[start:stop]
        text_words = words(raw, n + 2 * length)
        hashes = _hash(text_words, slice(None), ANCHOR)[:n]
        assert n < 2**PLACE_BITS
        bits = np.uint64(PLACE_BITS)
        key = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
        span = 1
        while span * 2 <= wide:
            key[: n - span] = np.minimum(key[: n - span], key[span:])
            span *= 2
        if wide > span:
            key[: n - (wide - span)] = np.minimum(key[: n - (wide - span)], key[wide - span :])
        place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        inside = np.zeros(n + 1, dtype=np.int32)
        full = last >= first
        np.add.at(inside, first[full] - start, 1)
        np.add.at(inside, last[full] - start + 1, -1)
        inside = np.cumsum(inside[:n]) > 0
        begins = np.empty(n, dtype=bool)
        begins[0] = True
        np.not_equal(place[1:], place[:-1], out=begins[1:])
        begins[1:] |= ~inside[:-1]
        begins[first[full] - start] = True
        begins &= inside
        at = np.flatnonzero(begins)
        ends = np.flatnonzero(inside & np.r_[begins[1:] | ~inside[1:], True])
        yield hashes[place[at]], at + start, ends - at + 1, place[at] - at, text_words, start


def _parts(at: np.ndarray, count: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs parted where the bytes before the anchor pass a multiple of ``STEP``: first window, windows, and the anchor's place in the first.

    A window's place around its anchor decides, so equal windows are in like parts.
    """
    last = (off - count + 1) // STEP  # the anchor's place falls from window to window
    n = off // STEP - last + 1
    run = np.repeat(np.arange(len(at)), n)
    step = off[run] // STEP - (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n))
    high = np.minimum(off[run], (step + 1) * STEP - 1)
    low = np.maximum((off - count + 1)[run], step * STEP)
    return at[run] + off[run] - high, high - low + 1, high


def _beside(text_words: np.ndarray, at: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the bytes around the anchor that all windows of a like part hold (``length - STEP + 1`` of them)."""
    most = length - ANCHOR - (STEP - 1)
    return _hash(text_words, at + off - np.minimum(off // STEP * STEP, most), length - STEP + 1)


def _class_hash(text_words: np.ndarray, at: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Of the texts that runs cover, by their first and last window, which overlap; the run's length goes in."""
    h = _hash(text_words, at, length, seed=0x5851F42D)
    h += _hash(text_words, at + count - 1, length, seed=0x14057B7E) * _K[1]
    h += count.astype(np.uint64) * _K[2]
    return _mixed(h, 2)


def _send(to: list[int], sender: int, kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(to)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([sender] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(blobs, pa.binary())], schema=_PART)


def _deflate(raw: bytes | pa.Buffer) -> bytes:
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _inflate(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], int(np.frombuffer(blob, np.int64, 1)[0]), "zstd", asbytes=True)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as one compressed blob: all numbers' lowest bytes, then the next ones and so on, as the upper ones hardly differ."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return _deflate(b"".join([np.array([len(c) for c in columns], np.int64).tobytes(), *planes]))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = _inflate(blob)
    out, at = [], 8 * len(kinds)
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of ordered numbers; ``np.cumsum`` of the same type takes them back."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def _sum(values: np.ndarray) -> np.ndarray:
    """What vouches for a list: its sum, in 64 bits."""
    return np.array([values.sum(dtype=np.uint64)])


def _vouched(mine: np.ndarray, told: np.ndarray) -> None:
    if mine.sum(dtype=np.uint64) != told[0]:
        raise ValueError("the documents aren't the same when they are read again")


def _bits(blob: bytes, listed: np.ndarray, n_masks: int = 1) -> list[np.ndarray]:
    """Masks over a list that was sent."""
    told, *masks = _unpack(blob, "<u8", *["u1"] * n_masks)
    _vouched(listed, told)
    return [np.unpackbits(m, count=len(listed)).astype(bool) for m in masks]


def _told(told: np.ndarray, *masks: np.ndarray) -> bytes:
    return _pack(_sum(told), *(np.packbits(m) for m in masks))


def _starts(*ordered: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before."""
    new = np.ones(len(ordered[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in ordered:
            new[1:] |= c[1:] != c[:-1]
    return new


def _code(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of an anchor, and in the lower half what the bucket knows it by. Anchors that it can't tell apart count as one, which costs work alone."""
    return (hashes >> _HALF) % np.uint64(n) << _HALF | hashes & np.uint64(0xFFFFFFFF)


def _key(code: np.ndarray) -> np.ndarray:
    return (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _cuts(code: np.ndarray, n: int) -> list[int]:
    """Where each bucket's share of ordered codes begins."""
    return np.searchsorted(code, np.arange(n + 1, dtype=np.uint64) << _HALF).tolist()


def _dealt(cuts: list[int], kind: int, sender: int, pack: Callable[[slice], bytes]) -> Iterator[pa.RecordBatch]:
    """A blob for each receiver that has rows."""
    sent = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
    for i in range(0, len(sent), 64):
        part = sent[i : i + 64]
        yield _send(part, sender, kind, [pack(slice(cuts[k], cuts[k + 1])) for k in part])


def _pack_docs(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return _deflate(sink.getvalue())


def _by_kind(parts: Iterator[pa.RecordBatch] | pa.Table) -> dict[int, dict[int, bytes]]:
    """Blobs by kind and sender, senders in order."""
    found: dict[int, dict[int, bytes]] = {}
    for batch in parts.to_batches() if isinstance(parts, pa.Table) else parts:
        for sender, kind, blob in zip(batch["sender"].to_pylist(), batch["kind"].to_pylist(), batch["blob"], strict=True):
            found.setdefault(kind, {})[sender] = blob.as_py()
    return {kind: dict(sorted(blobs.items())) for kind, blobs in found.items()}


def _table(parts: Iterator[pa.RecordBatch] | pa.Table) -> pa.Table | None:
    """The documents of a chunk."""
    blobs = [b for batch in (parts.to_batches() if isinstance(parts, pa.Table) else parts) for b in batch["blob"]]
    return pa.concat_tables([pa.ipc.open_stream(_inflate(b.as_py())).read_all() for b in blobs]).combine_chunks() if blobs else None


def _whole_texts(ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct (128 bits of a text, id) of the texts that have a window: these three; the rows, and each row's place among them; buckets' cuts."""
    rows = np.flatnonzero(np.diff(bounds) >= length)
    digests = b"".join([hashlib.blake2b(data[bounds[k] : bounds[k + 1]], digest_size=16).digest() for k in rows.tolist()])
    a, b = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    order = np.lexsort((ids[rows], b, a, a % np.uint64(n)))
    a, b, own = a[order], b[order], ids[rows[order]]
    new = _starts(a, b, own)
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    a, b, own = a[new], b[new], own[new]
    return a, b, own, rows, place, np.searchsorted(a % np.uint64(n), np.arange(n + 1)).tolist()


def _stretches(data: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray, int]]:
    """Texts of ``size`` bytes at ordered places, some at a time: which, characters of the stretch that holds them, its first byte."""
    lo = 0
    while lo < len(at):
        hi = int(np.searchsorted(at, at[lo] + SLICE, side="right"))
        start, stop = int(at[lo]), int(at[hi - 1]) + size
        raw = np.zeros(stop - start + 16, dtype=np.uint8)
        part = data[start:stop]
        raw[: len(part)] = part
        yield slice(lo, hi), words(raw, stop - start), start
        lo = hi


@dataclass
class _Classes:
    """What a chunk holds around shared anchors. Runs: row, first window, windows, class; classes in order: code, hash, smallest id, whether more ids, a run."""

    row: np.ndarray
    at: np.ndarray
    count: np.ndarray
    of: np.ndarray
    code: np.ndarray
    hash: np.ndarray
    least: np.ndarray
    several: np.ndarray
    run: np.ndarray


def _classes(ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, length: int, n: int, replies: dict[int, dict[int, bytes]]) -> tuple[_Classes, np.ndarray]:
    """Classes of a chunk, and its rows that are copies, by the replies to its anchors and whole texts."""
    copy = np.zeros(len(ids), dtype=bool)
    if _COPIES in replies:
        a, _, _, rows, place, cuts = _whole_texts(ids, data, bounds, length, n)
        found = np.zeros(len(a), dtype=bool)
        for k, blob in replies[_COPIES].items():
            (found[cuts[k] : cuts[k + 1]],) = _bits(blob, a[cuts[k] : cuts[k + 1]])
        copy[rows] = found[place]
    got = [(_code(hashes, n), at, count.astype(np.int16), off.astype(np.int16)) for hashes, at, count, off, _, _ in runs(data, bounds, length)] if _SHARED in replies else []
    got = got or [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.int16))]
    code, at, count, off = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    known = np.sort(code)
    known = known[_starts(known)]
    cuts = _cuts(known, n)
    shared, crowd = np.zeros(len(known), dtype=bool), np.zeros(len(known), dtype=bool)
    for k, blob in replies.get(_SHARED, {}).items():
        own = slice(cuts[k], cuts[k + 1])
        shared[own], crowd[own] = _bits(blob, known[own] & np.uint64(0xFFFFFFFF), 2)
    crowd, known = crowd[shared], known[shared]
    row = (np.searchsorted(bounds, at, side="right") - 1).astype(np.int32)
    hit = np.flatnonzero(~copy[row])
    hit = hit[_member(code[hit], known)]
    code, at, count, off = code[hit], at[hit], count[hit].astype(np.int64), off[hit].astype(np.int64)
    full = _member(code, known[crowd])
    forms = [(code[~full], at[~full], count[~full])]
    if full.any():
        part_at, part_count, part_off = _parts(at[full], count[full], off[full])
        beside = [_beside(text_words, part_at[own] - start, part_off[own], length) for own, text_words, start in _stretches(data, part_at, 3 * length)]
        forms.append((_code(np.concatenate(beside), n), part_at, part_count))
    code, at, count = (np.concatenate(x) for x in zip(*forms, strict=True))
    order = np.argsort(at, kind="stable")
    code, at, count = code[order], at[order], count[order]
    row = np.searchsorted(bounds, at, side="right") - 1
    cls = np.concatenate([np.zeros(0, np.uint64), *(_class_hash(text_words, at[own] - start, count[own], length) for own, text_words, start in _stretches(data, at, 3 * length))])
    order = np.lexsort((ids[row], cls, code))
    new = _starts(code[order], cls[order])
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    run = order[first]
    most = ids[row[order[np.r_[first[1:] - 1, len(order) - 1]]]] if len(order) else ids[:0]
    return _Classes(row, at, count, of, code[run], cls[run], ids[row[run]], most != ids[row[run]], run), copy


@dataclass
class _Bucket:
    """Entries of all chunks in a bucket, chunk by chunk, and their classes, which are numbered in order of keys."""

    cuts: dict[int, slice]
    hash: np.ndarray
    least: np.ndarray
    several: np.ndarray
    of: np.ndarray
    new_key: np.ndarray
    first: np.ndarray
    wanted: np.ndarray


def _bucket(blobs: dict[int, bytes]) -> _Bucket:
    got, cuts, at = [], {}, 0
    for sender, blob in blobs.items():
        steps, cls, least, several = _unpack(blob, "<u4", "<u8", "<i8", "u1")
        got.append((np.cumsum(steps, dtype=np.uint32), cls, least, np.unpackbits(several, count=len(steps)).astype(bool)))
        cuts[sender] = slice(at, at + len(steps))
        at += len(steps)
    key, cls, least, several = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((least, cls, key))
    new = _starts(key[order], cls[order])
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(order)])
    new_key = _starts(key[order[begin]])
    # texts of one document alone need no comparing; of the others each class is sent once, by chunks in turn
    key_begin = begin[new_key]
    held = np.diff(np.r_[key_begin, len(order)])
    more = (held > 1) | np.logical_or.reduceat(several[order], key_begin)
    asked = more[np.cumsum(new_key) - 1]
    wanted = np.zeros(len(order), dtype=bool)
    wanted[order[begin + (cls[order[begin]] % size.astype(np.uint64)).astype(np.int64)][asked]] = True
    return _Bucket(cuts, cls, least, several, of, new_key, order[begin], wanted)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they hold ``HELD`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", crowded: int = 4096) -> DataFrame:
    """Removes each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id.

    Texts are UTF-8 bytes; strings are judged on the input, and overlaps count. Returns the rows of ``docs`` with
    ``text_col`` replaced by the remaining text, plus ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` (of the remaining
    bytes) and ``spans`` (array of structs ``start``, ``stop``, in bytes). Where a span cuts a character of several bytes, the
    rest of it is left out of the text, not of the hash.

    Texts around anchors that ``crowded`` documents or more hold are sorted in parts. The result is the same at any value.

    Null and empty texts have nothing to remove. A null id is smaller than all others. Rows with the same id don't remove
    each other's strings. An empty table gives an empty result. Columns of ``docs`` with the names of the added ones are replaced.
    """
    if not ANCHOR + 8 <= length <= ANCHOR + 254:
        raise ValueError(f"strings must have {ANCHOR + 8} to {ANCHOR + 254} bytes")
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "_chunk")
    docs = docs.drop(*added)
    n = partitions(docs.sparkSession)
    chunk = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)).cast("int")
    keyed = docs.withColumn("_chunk", chunk)
    columns = docs.columns
    result = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>")
    result = T.StructType([*docs.schema.fields, *result.fields])
    arrow = to_arrow_schema(result)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batches(batches):
            table = table.combine_chunks()
            chunks = table["_chunk"].to_numpy()
            order = np.argsort(chunks, kind="stable")
            cuts = np.searchsorted(chunks[order], np.arange(n + 1))
            table = table.select(columns)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                own = table.take(pa.array(order[cuts[k] : cuts[k + 1]])).combine_chunks()
                yield _send([k] * len(own.to_batches()), 0, _DOCS, [_pack_docs(b) for b in own.to_batches()])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        table = _table(batches)
        if table is None:
            return
        me = batches[0]["to"][0].as_py()
        ids, data, bounds = _columns(table, id_col, text_col)
        a, b, own, _, _, cuts = _whole_texts(ids, data, bounds, length, n)
        yield from _dealt(cuts, _WHOLE, me, lambda k: _pack(a[k], b[k], own[k]))
        got = [(_code(hashes, n), (np.searchsorted(bounds, at, side="right") - 1).astype(np.int32)) for hashes, at, _, _, _, _ in runs(data, bounds, length)]
        if not got:
            return
        code, row = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(code, kind="stable")  # rows are in order
        code, row = code[order], row[order]
        once = _starts(code, row)  # once a document
        begin = np.flatnonzero(_starts(code))
        more = np.minimum(np.add.reduceat(once, begin, dtype=np.int64) - 1, 65535).astype(np.uint16)
        code = code[begin]
        yield from _dealt(_cuts(code, n), _ANCHORS, me, lambda k: _pack(_steps(_key(code[k])), more[k]))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        got = _by_kind(batches)
        if not got:
            return
        me = batches[0]["to"][0].as_py()
        if _WHOLE in got:
            lists = {k: _unpack(blob, "<u8", "<u8", "<i8") for k, blob in got[_WHOLE].items()}
            a, b, own = (np.concatenate(x) for x in zip(*lists.values(), strict=True))
            order = np.lexsort((own, b, a))
            begin = np.flatnonzero(_starts(a[order], b[order]))
            copy = np.empty(len(a), dtype=bool)
            copy[order] = own[order] > np.repeat(own[order[begin]], np.diff(np.r_[begin, len(a)]))
            at = 0
            for k, (a, _, _) in lists.items():
                mine = copy[at : at + len(a)]
                at += len(a)
                if mine.any():
                    yield _send([k], me, _COPIES, [_told(a, mine)])
        if _ANCHORS in got:
            lists = {k: _unpack(blob, "<u4", "<u2") for k, blob in got[_ANCHORS].items()}
            lists = {k: (np.cumsum(steps, dtype=np.uint32), more) for k, (steps, more) in lists.items()}
            key, more = (np.concatenate(x) for x in zip(*lists.values(), strict=True))
            order = np.argsort(key, kind="stable")
            begin = np.flatnonzero(_starts(key[order]))
            held = np.add.reduceat(more[order].astype(np.int64) + 1, begin)
            docs_with = np.empty(len(key), dtype=np.int64)
            docs_with[order] = np.repeat(held, np.diff(np.r_[begin, len(key)]))
            at = 0
            for k, (key, _) in lists.items():
                mine = docs_with[at : at + len(key)]
                at += len(key)
                if (mine > 1).any():
                    yield _send([k], me, _SHARED, [_told(key, mine > 1, mine >= max(2, crowded))])

    def classes(key: tuple[pa.Scalar, ...], docs_: pa.Table, replies: pa.Table) -> pa.Table:
        table, got = _table(docs_), _by_kind(replies)
        if table is None or _SHARED not in got:
            return _PART.empty_table()
        x, _ = _classes(*_columns(table, id_col, text_col), length, n, got)
        return pa.Table.from_batches(_dealt(_cuts(x.code, n), _CLASSES, key[0].as_py(), lambda k: _pack(_steps(_key(x.code[k])), x.hash[k], x.least[k], np.packbits(x.several[k]))), _PART)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        got = _by_kind(batches).get(_CLASSES)
        if got:
            x = _bucket(got)
            for sender, own in x.cuts.items():
                if x.wanted[own].any():
                    yield _send([sender], batches[0]["to"][0].as_py(), _WANTED, [_told(x.hash[own], x.wanted[own])])

    def texts(key: tuple[pa.Scalar, ...], docs_: pa.Table, replies: pa.Table) -> pa.Table:
        table, got = _table(docs_), _by_kind(replies)
        if table is None or _WANTED not in got:
            return _PART.empty_table()
        ids, data, bounds = _columns(table, id_col, text_col)
        x, _ = _classes(ids, data, bounds, length, n, got)
        cuts = _cuts(x.code, n)

        def sent(k: int, blob: bytes) -> bytes:
            own = slice(cuts[k], cuts[k + 1])
            (mask,) = _bits(blob, x.hash[own])
            run = x.run[own][mask]
            size = x.count[run] + length - 1
            return _pack(x.count[run].astype(np.uint8), data[np.repeat(x.at[run] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))])

        return pa.Table.from_batches([_send([k], key[0].as_py(), _TEXTS, [sent(k, blob)]) for k, blob in got[_WANTED].items()], _PART)

    def first_docs(key: tuple[pa.Scalar, ...], entries: pa.Table, sent: pa.Table) -> pa.Table:
        got = _by_kind(sent).get(_TEXTS)
        if not got:
            return _PART.empty_table()
        x = _bucket(_by_kind(entries)[_CLASSES])
        del entries, sent
        count, flat = (np.concatenate(y) for y in zip(*(_unpack(b, "u1", "u1") for b in got.values()), strict=True))
        del got
        count = count.astype(np.int64)
        asked = x.of[x.wanted]  # the class of each text
        if len(asked) != len(count):
            raise ValueError("a text that was asked for is missing")
        starts = np.cumsum(count + length - 1) - (count + length - 1)
        text_words = words(np.r_[flat, np.zeros(length + 16, np.uint8)], len(flat) + length)
        if (_class_hash(text_words, starts, count, length) != x.hash[x.wanted]).any():
            raise ValueError("a text isn't the one that was asked for")
        least = x.least[x.first[asked]]
        # stretches of windows with one smallest document: text, first, last, document
        found = []
        rep = np.argsort(asked)  # texts in order of keys
        rep_count = count[rep]
        # whole anchors, or all like parts of one, at a time, as many as are to be sorted together
        anchor_new = _starts((np.cumsum(x.new_key) - 1)[asked[rep]])
        share = np.cumsum(rep_count) // SORTED
        lo = 0
        while lo < len(rep):
            hi = int(np.searchsorted(share, share[lo], side="right"))
            while hi < len(rep) and not anchor_new[hi]:
                hi += 1
            part, part_count = rep[lo:hi], rep_count[lo:hi]
            owner = np.repeat(np.arange(len(part)), part_count)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(part_count) - part_count, part_count)
            at = starts[part][owner] + within
            sorted_at, begins = sort_windows(text_words, at, length)
            docs_sorted = least[np.searchsorted(starts, sorted_at, side="right") - 1]
            g = np.cumsum(begins) - 1
            smallest = np.minimum.reduceat(docs_sorted, np.flatnonzero(begins))[g]
            back = np.argsort(sorted_at)  # to order of place, which at has after a sort too
            place_order = np.argsort(at)
            doc_of = np.empty(len(at), dtype=np.int64)
            doc_of[place_order] = smallest[back]
            a = np.flatnonzero(_starts(owner, doc_of))
            b = np.r_[a[1:] - 1, len(owner) - 1]
            last = np.where(within[b] == part_count[owner[a]] - 1, _LAST, within[b].astype(np.uint8))
            found.append((asked[part[owner[a]]], within[a].astype(np.uint8), last, doc_of[a]))
            lo = hi
        c, j0, j1, d = (np.concatenate(y) for y in zip(*found, strict=True))  # classes ascend
        first = np.searchsorted(c, np.arange(len(x.first) + 1))
        batches = []
        for sender, own in x.cuts.items():
            of = x.of[own]
            n_stretches = np.diff(first)[of]
            entry = np.repeat(np.arange(len(of)), n_stretches)
            which = first[of][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n_stretches) - n_stretches, n_stretches)
            useful = (d[which] < x.least[own][entry]) | x.several[own][entry]
            entry, which = entry[useful], which[useful]
            if len(entry):
                times = np.bincount(entry, minlength=len(of)).astype(np.uint8)
                batches.append(_send([sender], key[0].as_py(), _FOUND, [_pack(_sum(x.hash[own]), times, j0[which], j1[which], d[which])]))
        return pa.Table.from_batches(batches, _PART)

    def cleaned(key: tuple[pa.Scalar, ...], docs_: pa.Table, replies: pa.Table) -> pa.Table:
        table, got = _table(docs_), _by_kind(replies)
        if table is None:
            return arrow.empty_table()
        ids, data, bounds = _columns(table, id_col, text_col)
        x, copy = _classes(ids, data, bounds, length, n, got)
        marks = np.zeros(int(bounds[-1] - bounds[0]) + 1, dtype=np.int32)
        if _FOUND in got:
            cuts = _cuts(x.code, n)
            times = np.zeros(len(x.code), dtype=np.int64)
            parts = []
            for k, blob in got[_FOUND].items():  # buckets in order, as classes are
                told, times[cuts[k] : cuts[k + 1]], *stretches = _unpack(blob, "<u8", "u1", "u1", "u1", "<i8")
                _vouched(x.hash[cuts[k] : cuts[k + 1]], told)
                parts.append(stretches)
            j0, j1, d = (np.concatenate(y) for y in zip(*parts, strict=True))
            own = times[x.of]
            run = np.repeat(np.arange(len(own)), own)
            which = np.repeat((np.cumsum(times) - times)[x.of], own) + np.arange(len(run)) - np.repeat(np.cumsum(own) - own, own)
            ok = d[which] < ids[x.row[run]]
            run, which = run[ok], which[ok]
            at = x.at[run] - bounds[0]
            np.add.at(marks, at + j0[which], 1)
            np.add.at(marks, at + np.where(j1[which] == _LAST, x.count[run] - 1, j1[which]) + length, -1)
        for k in np.flatnonzero(copy).tolist():
            marks[bounds[k] - bounds[0]] += 1
            marks[bounds[k + 1] - bounds[0]] -= 1
        gone = np.cumsum(marks[:-1]) > 0
        at, out = 0, []
        for batch in table.to_batches(max_chunksize=1024):
            own = bounds[at : at + len(batch) + 1]
            out.append(_result(batch, data, own, gone[own[0] - bounds[0] : own[-1] - bounds[0]], columns, text_col))
            at += len(batch)
        return pa.Table.from_batches(out).cast(arrow)

    def met(left: DataFrame, right: DataFrame, meet: Callable, schema: str | T.StructType = _PART_SQL) -> DataFrame:
        """A function of all parts with one number on both sides."""
        return left.groupBy("to").cogroup(right.groupBy("to")).applyInArrow(meet, schema)

    # what is read more than once is the same exchange, which Spark writes once
    chunks = _to(keyed.mapInArrow(packed, _PART_SQL), n)
    flags = _to(_to(chunks.mapInArrow(anchors, _PART_SQL), n).mapInArrow(shared, _PART_SQL), n)
    entries = _to(met(chunks, flags, classes), n)
    asked = _to(flags.unionByName(entries.mapInArrow(wanted, _PART_SQL)), n)
    firsts = met(entries, _to(met(chunks, asked, texts), n), first_docs)
    return met(chunks, _to(flags.unionByName(firsts), n), cleaned, result)


def _to(parts: DataFrame, n: int) -> DataFrame:
    """Rows go to the partition whose number they name."""
    return parts.repartitionById(n, "to")


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def _result(batch: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, gone: np.ndarray, columns: list[str], text_col: str) -> pa.RecordBatch:
    """The batch without the bytes that are gone."""
    texts, removed, n_spans, digests, spans = [], [], [], [], []
    had_text = batch[text_col].is_valid().to_pylist()
    for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        own, out = data[lo:hi], gone[lo - bounds[0] : hi - bounds[0]]
        edges = np.flatnonzero(np.diff(np.r_[False, out, False]))
        left = own[~out].tobytes() if len(edges) else own.tobytes()
        pieces = [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]
        removed.append(hi - lo - len(left))
        n_spans.append(len(pieces))
        digests.append(hashlib.sha256(left).hexdigest())
        spans.append(pieces)
        texts.append(left.decode("utf-8", "ignore") if had_text[k] else None)
    arrays = {c: batch[c] for c in columns} | {text_col: pa.array(texts, pa.string())}
    arrays |= {"n_bytes": pa.array(np.diff(bounds), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    arrays["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
