import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrykit.llm.common import find_roots
from quarrykit.llm.suffix_sort import blind_tries, multikey_quicksort, sort_windows, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(b"abc\xff\x00"), min_size=60, max_size=600), st.integers(9, 50), st.integers(0, 5))
def test_windows_come_in_order(data, length, repeat):
    raw = np.array(data * (repeat + 1), dtype=np.uint8)
    text_words = words(np.r_[raw, np.zeros(80, np.uint8)], len(raw) + 60)
    at = np.arange(len(raw) - length + 1)
    order, begins = sort_windows(text_words, at, length)
    text = raw.tobytes()
    got = [text[i : i + length] for i in order]
    assert got == sorted(text[i : i + length] for i in at)
    assert begins.tolist() == [True] + [a != b for a, b in zip(got, got[1:])]


def test_many_windows_are_parted_by_pivots():
    rng = np.random.default_rng(4)
    raw = np.r_[np.tile(rng.integers(97, 99, 700, dtype=np.uint8), 20), rng.integers(97, 99, 16_000, dtype=np.uint8), np.full(6_000, 97, np.uint8)]
    text_words = words(np.r_[raw, np.zeros(80, np.uint8)], len(raw) + 60)
    at = rng.permutation(len(raw) - 49)
    order, begins = sort_windows(text_words, at, 50)
    text = raw.tobytes()
    got = [text[i : i + 50] for i in order]
    assert len(at) > 8 * 4096 and sorted(order) == sorted(at)
    assert got == sorted(got)
    assert begins.tolist() == [True] + [a != b for a, b in zip(got, got[1:])]


def test_quicksort_leaves_long_common_prefixes_to_tries():
    raw = np.frombuffer(b"x" * 20 + b"a" * 30 + b"x" * 20 + b"b" * 30 + b"\0" * 80, dtype=np.uint8)
    text_words = words(raw, 140)
    at, begins = multikey_quicksort(text_words, np.array([50, 0]), 40)
    assert begins.tolist() == [True, False]
    at, begins = blind_tries(text_words, at, begins, 40)
    assert at.tolist() == [0, 50] and begins.all()


def test_roots():
    assert find_roots(np.array([5, 3, 1]), np.array([4, 4, 0]), 6).tolist() == [0, 0, 2, 3, 3, 3]
