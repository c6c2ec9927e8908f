"""Word shingles as sets of 64-bit hashes, and their MinHash signatures, on NumPy arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Multipliers of bytes by their place in a part of a word of so many bytes.
_PLACES = np.random.default_rng(20240101).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


#: Bytes whose letters are hashed together.
PIECE = 2**20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes other than ASCII white space)."""
    edges = np.diff(np.concatenate([[0], (~_SPACE[data]).view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A hash of each word, in order. About ``PIECE`` bytes are worked on together."""
    starts, ends = word_bounds(data) if bounds is None else bounds
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, side="right")))
        begin, lengths = starts[lo], (ends[lo:hi] - starts[lo:hi])
        own = data[begin : ends[hi - 1]]
        letters = own[~_SPACE[own]].astype(np.uint64)
        letters += np.uint64(1)
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(len(letters)) - np.repeat(firsts, lengths)
        letters *= _PLACES[place % len(_PLACES)]
        if lengths.max() <= len(_PLACES):
            sums = np.add.reduceat(letters, firsts)
        else:  # parts of long words are hashed, and the hashes in turn
            part = np.unique(np.r_[firsts, np.flatnonzero(place % len(_PLACES) == 0)])
            inside, own = place[part] // len(_PLACES), np.add.reduceat(letters, part)
            own = np.where(inside > 0, mixed(own + mixed(inside.astype(np.uint64))), own)
            sums = np.add.reduceat(own, np.searchsorted(part, firsts))
        out[lo:hi] = mixed(sums + lengths.astype(np.uint64) * _K[0])
        lo = hi
    return out


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mixed(out * _K[0] + words[k : k + n])
    return out


def shingle_set(data: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text that has words is one shingle."""
    words = word_hashes(data)
    return np.unique(run_hashes(words, min(width, len(words)))) if len(words) else words


def multipliers(n_hashes: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest products with each factor (MinHash values)."""
    out = np.full(len(factors), np.uint64(2**64 - 1), dtype=np.uint64)
    for lo in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[lo : lo + 1024, None] * factors).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each of ``bands`` equal parts of a signature; the band's number goes in."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _K[0]
    for k in range(rows.shape[1]):
        out = mixed(out + rows[:, k])
    return out


def band_keys_of(sigs: np.ndarray, bands: int) -> np.ndarray:
    """``band_keys`` of each row of signatures."""
    rows = sigs.reshape(len(sigs), bands, -1).astype(np.uint64)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _K[0], (len(sigs), 1))
    for k in range(rows.shape[2]):
        out = mixed(out + rows[:, :, k])
    return out


def texts_of(column: object) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow column; nothing for nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(text):
        return
    bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield data[lo:hi]


#: Bytes of texts that are worked on together.
SLICE = 2**20


def slices_of(column: object) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Texts of an Arrow column in parts of about ``SLICE`` bytes, each with the row of its first."""
    held, size, begin = [], 0, 0
    for k, data in enumerate(texts_of(column)):
        held.append(data)
        size += len(data)
        if size >= SLICE:
            yield begin, held
            held, size, begin = [], 0, k + 1
    if held:
        yield begin, held
