"""Deep-shallow sorting of fixed-length windows of bytes, on NumPy arrays inside a task.

Suffixes are compared by eight-byte characters. A multikey quicksort sorts them to a shallow depth; groups
that still share that many bytes are finished by blind tries, which look only at the places where suffixes branch.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16
#: Parts of this size or less are finished by a plain sort.
SMALL = 4096


def words(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first ``n`` places of ``data`` on, as big-endian numbers; ``data`` needs 8 spare bytes."""
    out = np.empty(n, dtype=np.uint64)
    raw = data.tobytes()
    for i in range(min(8, n)):
        m = (n - i + 7) // 8
        out[i::8] = np.frombuffer(raw, ">u8", count=m, offset=i)
    return out


def _character(text_words: np.ndarray, at: np.ndarray, depth: int, length: int) -> np.ndarray:
    found = text_words[at + depth]
    spare = depth + 8 - length
    return found >> np.uint64(8 * spare) if spare > 0 else found


def multikey_quicksort(text_words: np.ndarray, at: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffix starts ``at`` by their first ``shallow`` bytes (``length`` at most).

    Returns the sorted starts and a mask that is true where a group of suffixes with equal first bytes begins.
    """
    depth_end = min(shallow, length)
    out = np.empty(len(at), dtype=at.dtype)
    begins = np.zeros(len(at), dtype=bool)
    todo = [(at, 0, 0)]  # suffixes, their place in the result, depth
    while todo:
        part, to, depth = todo.pop()
        if not len(part):
            continue
        if depth >= depth_end or len(part) == 1:
            out[to : to + len(part)] = part
            begins[to] = True
            continue
        char = _character(text_words, part, depth, length)
        if len(part) <= SMALL:
            # all characters down to the shallow depth at once
            chars = [char] + [_character(text_words, part, d, length) for d in range(depth + 8, depth_end, 8)]
            order = np.lexsort(chars[::-1])
            new = np.zeros(len(part), dtype=bool)
            new[0] = True
            for c in chars:
                c = c[order]
                new[1:] |= c[1:] != c[:-1]
            out[to : to + len(part)] = part[order]
            begins[to : to + len(part)] = new
            continue
        sample = char[:: max(1, len(char) // 999)]
        pivot = np.partition(sample, len(sample) // 2)[len(sample) // 2]
        less, same = char < pivot, char == pivot
        n_less, n_same = int(less.sum()), int(same.sum())
        todo.append((part[less], to, depth))
        todo.append((part[same], to + n_less, depth + 8))
        todo.append((part[~less & ~same], to + n_less + n_same, depth))
    return out, begins


def blind_tries(text_words: np.ndarray, at: np.ndarray, begins: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Finishes groups of suffixes that share their first ``shallow`` bytes, in all groups at once.

    In each round the first suffix of every open group is the leaf that a blind descent ends in. The others are compared with
    it once: the length they share and the character behind it are the branch they belong to. Those that never
    branch off equal it and are done; each branch is the group of the next round, from its own depth on.
    Returns the sorted starts and a mask that is true where suffixes that differ from the one before begin.
    """
    group = np.cumsum(begins) - 1
    size = np.bincount(group, minlength=0)
    open_ = size[group] > 1
    at, begins = at.copy(), begins.copy()
    where = np.flatnonzero(open_)  # places in the result that aren't settled
    while len(where):
        own = at[where]
        first = begins[where]
        g = np.cumsum(first) - 1
        lead = own[first][g]
        shared = np.full(len(own), length, dtype=np.int64)
        mine, theirs = np.zeros(len(own), dtype=np.uint64), np.zeros(len(own), dtype=np.uint64)
        rest = np.arange(len(own))
        for depth in range(shallow, length, 8):
            a, b = _character(text_words, own[rest], depth, length), _character(text_words, lead[rest], depth, length)
            off = a != b
            hit = rest[off]
            shared[hit], mine[hit], theirs[hit] = depth, a[off], b[off]
            rest = rest[~off]
            if not len(rest):
                break
        # smaller than the leaf: the earlier they branch off, the smaller; larger: the other way round
        rank = np.where(shared == length, 0, np.where(mine < theirs, shared - length - 1, length + 1 - shared))
        if not rank.any():
            break
        order = np.lexsort((mine, rank, g))
        at[where] = own[order]
        rank, mine, g = rank[order], mine[order], g[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (rank[1:] != rank[:-1]) | (mine[1:] != mine[:-1])]
        begins[where] = new
        n = np.bincount(np.cumsum(new) - 1)
        where = where[(rank != 0) & (n[np.cumsum(new) - 1] > 1)]
    return at, begins


def sort_windows(text_words: np.ndarray, at: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts ``at`` in order of their first ``length`` bytes, and where each distinct window begins."""
    return blind_tries(text_words, *multikey_quicksort(text_words, at, length, shallow), length, min(shallow, length))
