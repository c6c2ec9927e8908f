"""Repeated passages: short lines, places inside long lines, keys of near copies, and documents of any size."""

import collections

import numpy as np

from quarrykit.llm import paragraph_dedup
from quarrykit.llm.shingles import mixed, multipliers, run_hashes


def words(seed, n):
    return [f"v{k}" for k in np.random.default_rng(seed).integers(0, 10**6, n)]


def lines(seed, sizes):
    own = iter(words(seed, sum(sizes)))
    return "\n".join(" ".join(next(own) for _ in range(k)) for k in sizes)


def removed(spark, make, rows):
    """Words that go, as (document, place) pairs, by whole rows."""
    found = paragraph_dedup.repeated_passages(make(rows).repartition(4))
    out = collections.defaultdict(list)
    for r in found.collect():
        raw = dict(rows)[r.doc_id].encode()
        before = len(raw[: r.start].split())
        assert r.n_words == len(raw[r.start : r.stop].split())
        out[r.doc_id].append((before, before + r.n_words))
    return out


def repeats(rows, least):
    """Brute force: the runs of ``least`` words and more in later documents that are in an earlier one."""
    seen, out = set(), {}
    for i, t in rows:
        own = t.split()
        hit = np.zeros(len(own) + 1, dtype=bool)
        runs = [tuple(own[k : k + least]) for k in range(len(own) - least + 1)]
        for k, run in enumerate(runs):
            if run in seen:
                hit[k : k + least] = True
        edges = np.flatnonzero(np.diff(np.r_[False, hit].astype(int)))
        if len(edges):
            out[i] = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        seen.update(runs)
    return out


def test_passages_of_short_lines_equal_brute_force(spark, make):
    rows = []
    for n, sizes in enumerate([[4] * 15, [10, 3] * 8, [1, 2, 3, 4] * 10, [4, 30, 2, 2, 6, 3] * 2]):
        passage = lines(5 + n, sizes)
        rows += [(10 * n + i, lines(1000 * n + 100 + i, [12, 3, 9]) + "\n" + passage + "\n" + lines(1000 * n + 200 + i, [3, 20, 7])) for i in range(6)]
    assert removed(spark, make, rows) == repeats(rows, 22) and len(repeats(rows, 22)) == 20


def test_passages_inside_lines_are_found_whole(spark, make):
    rows, k = [], 0
    for p in range(20):
        passage = " ".join(words(1000 + p, 55))
        rows.append((k, passage))
        for j in range(1, 6):
            rows.append((k + j, " ".join(words(5000 + k + j, 3 * j + p)) + (". " if j % 2 else "\u3002 ") + passage + " " + " ".join(words(9000 + k + j, 10 + p))))
        k += 6
    got, want = removed(spark, make, rows), repeats(rows, 22)
    assert set(got) == set(want) and len(want) == 100
    for i, ((lo, hi),) in want.items():
        # a piece at an end may hold some other words and still be a near copy of another document's
        assert len(got[i]) == 1 and lo - 6 <= got[i][0][0] <= lo and hi <= got[i][0][1] <= hi + 6


def test_near_sets_always_share_a_key():
    rng, factors = np.random.default_rng(3), multipliers(paragraph_dedup.BANDS * paragraph_dedup.ROWS, seed=9)
    pairs = []
    for _ in range(6000):
        n = int(rng.integers(1, 60))
        a = mixed(rng.integers(1, 2**62, n).astype(np.uint64))
        lost = int(rng.integers(0, n // 5 + 1))
        new = int(rng.integers(0, n + 1))
        while (n - lost) < 0.8 * (n + new):
            new -= 1
        if new < 0:
            continue
        b = rng.permutation(np.r_[a[lost:], mixed(rng.integers(1, 2**62, new).astype(np.uint64)), a[lost : lost + int(rng.integers(0, 3))]])
        pairs.append((a, b))
    runs = np.concatenate([x for p in pairs for x in p])
    count = np.array([len(x) for p in pairs for x in p])
    who, key = paragraph_dedup.unit_keys(runs, np.cumsum(count) - count, count, 0.8, factors)
    keys = collections.defaultdict(set)
    for w, x in zip(who.tolist(), key.tolist(), strict=True):
        keys[w].add(x)
    assert len(pairs) > 3000 and all(keys[2 * k] & keys[2 * k + 1] for k in range(len(pairs)))


def test_a_long_document_and_null_ids_change_nothing(spark, make):
    passage, other = lines(7, [9] * 6), lines(8, [9] * 6)
    n = 2**20 + 5
    own = np.random.default_rng(1).integers(0, 10**9, (n, 5)).tolist()
    long = "\n".join("%d %d %d %d %d" % tuple(x) for x in own)
    rows = [(1, passage), (2, long + "\n" + passage), (3, passage + "\n" + lines(9, [9])), (4, other), (None, lines(10, [9]) + "\n" + other), (None, lines(11, [9, 9])), (-5, lines(12, [9]))]
    docs = make(rows).coalesce(1)
    found = paragraph_dedup.repeated_passages(docs)
    assert sorted((r.doc_id or 0, r.n_words, r.kept_doc_ids) for r in found.collect()) == [(0, 54, [4]), (2, 54, [1]), (3, 54, [1])]
    left = [r.text for r in paragraph_dedup.remove_passages(docs.where("doc_id IS NULL"), found).collect()]
    assert sorted(left) == sorted([lines(10, [9]) + "\n", lines(11, [9, 9])])


def test_documents_that_repeat_whole_go_at_any_length(spark, make):
    four = "\n".join(" ".join(words(k, 4)) for k in range(40))
    rows = [(1, four), (2, four), (3, " ".join(words(60, 20))), (4, " ".join(words(60, 20))), (5, "one two"), (6, "one  two"), (7, "one two three"), (8, ""), (9, None), (10, " ".join(words(60, 20)) + "\n" + lines(61, [30]))]
    found = paragraph_dedup.repeated_passages(make(rows))
    assert sorted((r.doc_id, r.n_words, r.kept_doc_ids) for r in found.collect()) == [(2, 160, [1]), (4, 20, [3]), (6, 2, [5])]


def test_one_id_with_two_texts_and_ids_of_any_size(spark, make):
    a, b = lines(70, [30, 9]), lines(71, [30, 9])
    rows = [(1, a), (1, b), (2**50, a), (-1, b), (None, a), (None, b), (None, b + "\n" + lines(72, [12]))]
    found = sorted((r.doc_id is None, r.doc_id, r.n_words, r.kept_doc_ids) for r in paragraph_dedup.repeated_passages(make(rows)).collect())
    assert found == sorted([(False, 2**50, 39, [1]), (False, 1, 39, [-1]), (True, None, 39, [1]), (True, None, 39, [-1]), (True, None, 39, [-1])], key=lambda x: (x[0], x[1] or 0, x[2:]))


def test_near_lines_equal_brute_force(spark, make):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(60):
        own = words(400 + k, int(rng.integers(24, 90)))
        for j in range(4):
            t = list(own)
            for _ in range(int(rng.integers(0, 4)) if j else 0):
                t[int(rng.integers(len(t)))] = f"x{k}-{j}"
            rows.append((4 * k + j, " ".join(t)))
    sets = {i: {tuple(t.split()[m : m + 5]) for m in range(len(t.split()) - 4)} for i, t in rows}
    root = {}
    for i, _ in rows:
        near = {root[j] for j in root if i // 4 == j // 4 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
        root[i] = min([i, *near])
        for j in root:
            if root[j] in near:
                root[j] = root[i]
    gone = {i for i in root if root[i] != i}
    # whole lines go by their links alone; others may lose pieces
    found = {r.doc_id: r for r in paragraph_dedup.repeated_passages(make(rows)).where("n_paragraphs > 0").collect() if r.n_words == len(dict(rows)[r.doc_id].split())}
    assert gone <= set(found) and len(gone) > 60


def test_each_string_of_a_passage_holds_an_anchor():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, k, n).astype(np.uint64) for k in (2, 3, 50, 10**6) for n in (0, 1, 7, 8, 9, 21, 22, 23, 400)]
    texts += [np.tile(rng.integers(0, 99, p).astype(np.uint64), 300 // p) for p in (1, 2, 3, 7, 8, 11, 20)]
    for passage in (3, 8, 9, 22, 60):
        run = min(8, passage)
        hashes = mixed(np.concatenate(texts))
        first = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
        count = np.array([max(0, len(t) - run + 1) for t in texts])
        runs = run_hashes(hashes, run)
        got = set(paragraph_dedup.anchors(runs, first, count, passage - run + 1).tolist())
        window = passage - run + 1
        for lo, n in zip(first.tolist(), count.tolist(), strict=True):
            for k in range(lo, lo + max(min(n, 1), n - window + 1)):
                own = runs[k : min(k + window, lo + n)]
                assert any(k + i in got for i in np.flatnonzero(own == own.min()))
        assert all(any(lo <= x < lo + n for lo, n in zip(first.tolist(), count.tolist(), strict=True)) for x in got)
    # a text of one word has few anchors, others about one in eight words
    one = run_hashes(mixed(np.zeros(8000, np.uint64)), 8)
    assert len(paragraph_dedup.anchors(one, np.array([0]), np.array([len(one)]), 15)) <= 1002


def test_passages_of_22_words_and_more_anywhere_in_lines_equal_brute_force(spark, make):
    rows, k = [], 0
    for n in (22, 23, 26, 30, 36, 45):
        for p in range(40):
            own = words(10_000 * n + p, n)
            for j in range(2):
                around = words(777_777 + 1000 * n + 10 * p + j, 60)
                broken = "\n".join(" ".join(own[i : i + 4 + j]) for i in range(0, n, 4 + j)) if p % 2 else " ".join(own)
                rows.append((k, " ".join(around[:30]) + " " + broken + " " + " ".join(around[30:])))
                k += 1
    want = repeats(rows, 22)
    assert len(want) == 240 and removed(spark, make, rows) == want


def test_the_words_between_anchors_are_compared_too(spark, make):
    own = words(31, 300)
    rows = [(0, " ".join(own))]
    for k in range(1, 40):
        other = list(own)
        for at in (60 + k, 140 + k, 220 + k):
            other[at] = f"x{k}-{at}"
        rows.append((k, "\n".join(" ".join(other[i : i + 100]) for i in (0, 100, 200)) if k % 2 else " ".join(other)))
    got = removed(spark, make, [rows[0], *((k, t.replace("\n", " | | ")) for k, t in rows[1:])])
    kept = {k: len(t.replace("\n", " | | ").split()) - sum(b - a for a, b in got[k]) for k, t in rows}
    # a line that is near as a whole goes whole
    assert all(n in (0, 3, 7) for k, n in kept.items() if k) and kept[0] == 300


def test_words_over_and_over_leave_one_round(spark, make):
    rows = [(0, " ".join(["a b c"] * 200)), (1, " ".join(["d"] * 500)), (2, lines(3, [30]) + " " + " ".join(["d"] * 500))]
    got = removed(spark, make, rows)
    assert sum(b - a for a, b in got[0]) >= 540 and sum(b - a for a, b in got[1]) >= 450 and got[2][-1][1] == 530
    assert got[0][0][0] >= 3 and got[1][0][0] >= 1 and got[2][0][0] >= 30
