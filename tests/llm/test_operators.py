"""Every operator on small documents, against brute force, with nulls, empty tables, repeats and clashing columns."""

import base64
import collections
import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import buckets, embedding_dedup, jaccard_join, mixing, packing, paragraph_dedup, quality, sharding, shingles, suffix_dedup, toxicity, warc
from quarrykit.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.helpers import SMALL, same_rows

WORDS = [f"w{k}" for k in range(400)]


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] + ("." if j % 9 == 8 else "") for j, k in enumerate(rng.integers(0, 400, n)))


PASSAGE = prose(99, 55)
DOCS = [
    (0, prose(0)), (1, prose(0)), (2, prose(2) + "\n" + PASSAGE), (3, prose(3) + " " + PASSAGE + " " + prose(4)), (4, None), (5, ""), (6, "   \n\t"),
    (7, "short text"), (8, "short text"), (9, prose(9, 3000)), (None, prose(10)), (11, prose(0).replace("w", "w", 1) + " w1 w2"), (12, "é" * 60 + prose(12)), (13, "e" + "é" * 60 + "x"),
]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLE_SQL[name])


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# sources


def test_mix_is_seeded_and_near_its_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit("x").alias("copy"))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    mixed = mixing.mix_sources(docs, weights, seed=3)
    counts = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(counts["a"] - 4500) < 250 and abs(counts["b"] - 1500) < 150
    again = mixing.mix_sources(docs.repartition(7), weights, seed=3)
    assert sorted(map(tuple, mixed.select("doc_id", "copy").collect())) == sorted(map(tuple, again.select("doc_id", "copy").collect()))


def test_mix_of_large_means_nulls_and_nothing(spark, make):
    one = mixing.mix_sources(spark.createDataFrame([(1, "t", None)], "doc_id long, text string, source string"), total=3000.0)
    assert abs(one.count() - 3000) < 400
    assert mixing.mix_sources(make(DOCS).limit(0)).count() == 0
    weights = spark.createDataFrame([("none", 1.0)], "source string, weight double")
    assert mixing.mix_sources(make(DOCS), weights).count() == 0
    # columns that clash change nothing
    plain, clashing = (collections.Counter((r.doc_id, r.text, r.copy) for r in mixing.mix_sources(make(DOCS, clash=c)).collect()) for c in ((), ("copies", "_rate")))
    assert plain == clashing and plain


# packing


def test_other_tokenizers_get_whole_texts(make, tmp_path):
    from tokenizers import Tokenizer

    assert packing.by_words(Tokenizer.from_file(tokenizer_path()))
    other = os.path.join(os.path.dirname(tokenizer_path()), "byte_bpe_50k.json")
    cut = Tokenizer.from_file(other)
    cut.enable_truncation(8)
    cut.save(str(tmp_path / "cut.json"))
    tokenizer = Tokenizer.from_file(other)
    rows = [(k, t) for k, t in enumerate(["two  words", " led\tby space\n\n and\u00a0more", "I'll, we've", "", None, "x " * 3000, "\x1cé ß 東京 \U0001f600"])]
    for path in (other, str(tmp_path / "cut.json")):
        got: dict[int, list[int]] = {k: [] for k, _ in rows}
        for r in sorted(packing.tokenize_pieces(make(rows), path, keep_ids=True).collect(), key=lambda r: (r.doc_id, r.piece)):
            got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        assert got == {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in rows}
    assert not packing.by_words(tokenizer)
    # added tokens that go over white space, or are plain words
    for added, whole in (("new york", True), ("w1 w2", True), ("York", True), ("end.", True), ("<|mark|>", False)):
        extended = Tokenizer.from_file(tokenizer_path())
        extended.add_tokens([added])
        assert packing.by_words(extended) is not whole
        extended.save(str(tmp_path / "added.json"))
        plain = Tokenizer.from_file(str(tmp_path / "added.json"))
        text = f"in new york w1 w2 York, york end. the<|mark|>end {added} x{added}y"
        packing._words.cache_clear()
        packing._tokenizer.cache_clear()
        (got,) = packing.token_bytes([text], str(tmp_path / "added.json"))
        assert np.frombuffer(got, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_pieces_are_what_the_tokenizer_says(make):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    odd = [(20, "It's A.B, don't?! 3x4 ÄÖ ß x y"), (21, "a\x1cb \x85 c"), (22, "ﬁ Å Å İstanbul Σίσυφος <|endoftext|> x"), (23, "…–— ,.!? ;:"), (24, "word́ é")]
    rows = DOCS + odd
    got = {}
    for r in packing.tokenize_pieces(make(rows), tokenizer_path(), keep_ids=True).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)))
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want = [(k, at, len(own := ids[at : at + 4096]), zlib.crc32(raw := np.array(own, dtype="<u4").tobytes()), raw) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted(got[doc_id]) == want, text


def test_packing_is_gapless_and_tight(spark, make):
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6, 1.1, 3000).astype(int) + 1).tolist() + [7] * 2000 + [4096] * 3
    pieces = spark.createDataFrame([(k % 1500, 0, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long")
    rows = packing.pack(pieces).collect()
    assert len(rows) == len(lengths)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 4096
    assert len(by) <= -(-sum(lengths) // 4096) + 2
    assert packing.pack(pieces.limit(0)).count() == 0
    whole = packing.assemble(packing.pack_documents(make(DOCS), tokenizer_path(), keep_ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in packing.tokenize_pieces(make(DOCS), tokenizer_path()).collect())


def test_exact_complements_come_first():
    plan, n = packing.plan_packing({60: 3, 30: 2, 10: 2, 40: 1, 20: 3}, 100)
    assert n == 4  # 60+40, 60+30+10 twice, and the rest
    assert packing.plan_packing({}, 100)[1] == 0
    assert packing.plan_packing({100: 5}, 100)[1] == 5
    assert packing.plan_packing({50: 3}, 100)[1] == 2


# suffixes


def _without_repeats(rows, length=50):
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        raw, own = (text or "").encode(), -1 if doc_id is None else doc_id
        gone = np.zeros(len(raw) + 1, dtype=int)
        for k in range(len(raw) - length + 1):
            if seen.setdefault(raw[k : k + length], own) < own:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        left = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[doc_id] = (len(raw), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0, hashlib.sha256(left).hexdigest())
    return out


def test_repeats_go_as_by_brute_force(spark, make):
    rows = DOCS + [(30, "ab" * 90), (31, "x" + "ab" * 60 + "y"), (32, prose(2)[:200] + prose(9, 3000)[500:900])]
    cleaned = suffix_dedup.remove_repeats(make(rows, clash=("spans", "n_bytes")).repartition(5))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cleaned.collect()}
    assert got == _without_repeats(rows)
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts[4] is None and texts[5] == "" and texts[1] == "" and texts[0] == prose(0)
    assert suffix_dedup.remove_repeats(make(DOCS).limit(0)).count() == 0


def test_equal_windows_have_equal_anchors_whatever_the_slice(monkeypatch):
    rng = np.random.default_rng(6)
    passage = rng.integers(97, 101, 400, dtype=np.uint8)
    texts = [np.concatenate([rng.integers(97, 101, int(rng.integers(0, 300)), dtype=np.uint8), passage, rng.integers(97, 101, int(rng.integers(0, 3000)), dtype=np.uint8)]) for _ in range(12)]
    texts += [np.full(300, 97, np.uint8), np.full(500, 97, np.uint8), np.tile(passage[:30], 40)]
    data = np.concatenate(texts)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    anchor: dict[bytes, set] = {}
    for size in (2**7, 2**9, 2**12, 2**20):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        seen = []
        for hashes, at, count, off, _, _ in suffix_dedup.runs(data, bounds, 50):
            for h, a, c, o in zip(hashes.tolist(), at.tolist(), count.tolist(), off.tolist(), strict=True):
                for k in range(c):
                    anchor.setdefault(data[a + k : a + k + 50].tobytes(), set()).add((h, o - k))
                    seen.append(a + k)
        assert sorted(seen) == [p for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) for p in range(lo, hi - 49)]
    assert all(len(x) == 1 for x in anchor.values())


def test_windows_of_a_frequent_phrase_part_by_the_bytes_beside_it(make):
    rng = np.random.default_rng(8)
    phrase = "in nearly all documents"
    beside = ["".join(chr(97 + k) for k in rng.integers(0, 26, 40)) for _ in range(150)]
    rows = [(k, beside[rng.integers(0, 150)][: rng.integers(0, 41)] + phrase + beside[rng.integers(0, 150)]) for k in range(300)]
    want = _without_repeats(rows)
    for crowded in (2, 20, 4096):
        cleaned = suffix_dedup.remove_repeats(make(rows).repartition(7), crowded=crowded)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cleaned.collect()} == want
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    bounds = np.r_[0, np.cumsum([len(t) for _, t in rows])]
    group: dict[bytes, set] = {}
    size: dict[int, set] = {}
    whole: dict[int, set] = {}
    for hashes, at, count, off, text_words, start in suffix_dedup.runs(data, bounds, 50):
        for h, a, c in zip(hashes.tolist(), at.tolist(), count.tolist(), strict=True):
            whole.setdefault(h, set()).update(data[a + k : a + k + 50].tobytes() for k in range(c))
        part_at, part_count, part_off = suffix_dedup._parts(at, count, off)
        assert part_count.sum() == count.sum() and (part_count > 0).all()
        for h, a, c in zip(suffix_dedup._beside(text_words, part_at - start, part_off, 50).tolist(), part_at.tolist(), part_count.tolist(), strict=True):
            for k in range(c):
                window = data[a + k : a + k + 50].tobytes()
                group.setdefault(window, set()).add(h)
                size.setdefault(h, set()).add(window)
    assert all(len(x) == 1 for x in group.values())
    assert max(map(len, size.values())) < max(map(len, whole.values())) / 4


def test_repeats_of_other_lengths(make):
    rows = [r for r in DOCS if r[0] != 9] + [(20, prose(20, 150)), (21, "x" + prose(20, 150)[3:700]), (22, prose(20, 150)[100:420] + prose(21)), (23, "y" + prose(20, 150)[90:430])]
    for length in (28, 180, 274):
        for crowded in (2, 4096):
            cleaned = suffix_dedup.remove_repeats(make(rows).repartition(3), length, crowded=crowded)
            assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cleaned.collect()} == _without_repeats(rows, length)
    for length in (27, 275):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(make(rows), length)


def _shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_documents_are_shuffled_once_and_shared_texts_go_once(spark, make):
    texts = [prose(400 + k, 1500) for k in range(25)]
    rows = [(40 * v + k, f"version {v}\n{t}" if v % 3 else t) for v in range(12) for k, t in enumerate(texts)]
    rows += [(1000 + k, t[500:1500] + prose(500 + k, 20) + t[3000:3600]) for k, t in enumerate(texts)]
    docs = make(rows).repartition(3)
    before = _shuffled(spark)
    docs.write.format("noop").mode("overwrite").save()
    dealt = _shuffled(spark) - before
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).drop("text", "spans").collect()}
    shuffled = _shuffled(spark) - before - 2 * dealt
    assert got == _without_repeats(rows)
    assert shuffled < 1.3 * sum(len(t) for _, t in rows)


def test_rows_with_one_id_do_not_remove_each_other(make):
    cleaned = suffix_dedup.remove_repeats(make([(1, prose(0)), (1, prose(0)), (2, prose(0))]))
    assert sorted((r.doc_id, r.n_removed > 0) for r in cleaned.collect()) == [(1, False), (1, False), (2, True)]


# shards


def test_shards_are_contiguous_balanced_and_gapless(make):
    rows = DOCS + [(100 + k, prose(k, 5 + k % 50)) for k in range(300)]
    placed = sharding.shard_by_bytes(make(rows), n_shards=7).collect()
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {r.doc_id: (r.size, r.text_crc32) for r in placed} == want
    placed.sort(key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in placed if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)
    sums = collections.Counter()
    for r in placed:
        sums[r.shard] += r.size
    for _, own in itertools.groupby(placed, key=lambda r: r.shard):
        assert [r.slot for r in own] == list(range(sum(1 for r in placed if r.shard == _)))
    assert max(sums.values()) - sum(sums.values()) / 7 <= max(s for s, _ in want.values())
    assert sharding.shard_by_bytes(make(DOCS).limit(0)).count() == 0
    assert sharding.shard_by_bytes(make([(1, "a"), (1, "a")])).count() == 2
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(make(DOCS), n_shards=0)


# near duplicates


def _sets(text, width=5):
    w = _words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_jaccard_links_equal_brute_force(make):
    base = prose(50, 120).split()
    near = [(200 + k, " ".join(base[:k] + ["zz"] + base[k + 1 :])) for k in range(0, 120, 7)]
    rows = [(i, t) for i, t in DOCS if i is not None] + near + [(300, near[0][1]), (301, near[0][1])]
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(make(rows, clash=("rep", "class_id")).repartition(3)).collect()}
    sets, links, parent = {i: _sets(t) for i, t in rows}, collections.Counter(), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        shared = len(sets[a] & sets[b])
        if shared and 5 * shared >= 4 * len(sets[a] | sets[b]):
            links.update((a, b))
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], find(i), find(i) == i) for i in sets}
    assert got[301].class_id == got[300].class_id == 200
    assert jaccard_join.jaccard_join(make(DOCS).limit(0)).count() == 0
    assert [r.n_links for r in jaccard_join.jaccard_join(make([(None, prose(1)), (None, prose(1)), (3, None)])).orderBy("doc_id").collect()] == [1, 1, 0]


def test_large_groups_meet_block_by_block(make, monkeypatch):
    monkeypatch.setattr(buckets, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base = prose(51, 200).split()
    rows = [(k, " ".join(base[:k] + ["zz"] + base[k + 1 :])) for k in range(40)]
    got = jaccard_join.jaccard_join(make(rows)).collect()
    sets = {i: _sets(t) for i, t in rows}
    want = {i: sum(i != j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    assert {r.doc_id: r.n_links for r in got} == want


@pytest.mark.parametrize("n", [300, 1200])
def test_chains_are_verified_where_their_pairs_meet(make, monkeypatch, n):
    monkeypatch.setattr(buckets, "BLOCK", 64)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    places, meetings = [], jaccard_join._meetings

    def counted(nodes, *rest):
        found = meetings(nodes, *rest)
        places.append((nodes.count(), found.count()))
        return found

    monkeypatch.setattr(jaccard_join, "_meetings", counted)
    long, thick = prose(55, 5 * n + 60).split(), prose(56, 150).split()
    rows = [(k, " ".join(long[5 * k : 5 * k + 60])) for k in range(n)]
    rows += [(n + k, " ".join(thick[:k] + ["zz"] + thick[k + 1 :])) for k in range(0, 150, 2)] + [(2 * n, rows[7][1]), (2 * n, rows[7][1])]
    got = {(r.doc_id, r.class_id): (r.n_links, r.component_id) for r in jaccard_join.jaccard_join(make(rows).repartition(5)).collect()}
    sets = [_sets(t) for _, t in rows]
    holders = collections.defaultdict(set)
    for k, own in enumerate(sets):
        for x in own:
            holders[x].add(k)
    for k, (i, _) in enumerate(rows):
        near = {j for x in sets[k] for j in holders[x]} - {k}
        links = sum(5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]) for j in near)
        assert got[i, 7 if i == 2 * n else i] == (links, 0 if i < n or i == 2 * n else n)
    # the thick group goes the other way, and a document of the chain has a few places, however long the chain is
    assert places[0][0] == n and places[0][1] < 12 * n


def test_pairs_count_at_their_first_shared_key():
    rng = np.random.default_rng(3)
    keys = rng.integers(-2, 3, (40, 6)) * 10 + np.arange(6)
    every = lambda left, right: tuple(left[x] for x in np.triu_indices(len(left), 1))
    seen = collections.Counter()
    for own in np.unique(keys):
        at = np.flatnonzero((keys == own).any(axis=1))
        seen.update(zip(*(x.tolist() for x in buckets.first_shared(every, keys, own)(at, None)), strict=True))
    assert seen == {(a, b): 1 for a, b in itertools.combinations(range(40), 2) if (keys[a] == keys[b]).any()}


def test_rows_with_one_or_no_id_are_documents_of_their_own(spark):
    a, b = prose(52, 100), prose(53, 100)
    near_a, near_b = a + " w1", b + " w2"
    rows = [(None, a, 0), (None, b, 1), (3, near_a, 2), (4, near_b, 3), (1, a, 4), (1, b, 5), (1, b, 6), (None, prose(54), 7), (None, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long")
    got = {r.at: (r.n_links, r.component_id, r.kept) for r in jaccard_join.jaccard_join(docs, row_col="at").collect()}
    assert got == {0: (2, 1, False), 2: (2, 1, False), 4: (2, 1, True), 1: (3, 1, False), 3: (3, 1, False), 5: (3, 1, True), 6: (3, 1, False), 7: (0, None, True), 8: (0, None, True)}
    plain = jaccard_join.jaccard_join(docs.drop("at")).collect()
    assert sorted((r.n_links, r.kept) for r in plain) == sorted((n, k) for n, _, k in got.values())


def test_words_of_any_length_hash_by_all_their_letters():
    one, two = b"a" * 4096, b"b" * 4096
    long = [one + two + b"c", two + one + b"c", one + one + b"c", one + two + b"d", b"ab", b"ab c " + one + two + b"c"]
    hashed = [shingles.word_hashes(np.frombuffer(x, np.uint8)).tolist() for x in long]
    assert len({x[0] for x in hashed[:4]}) == 4 and hashed[5][0] == hashed[4][0] and hashed[5][2] == hashed[0][0]


def test_forests_join_what_links_join():
    rng = np.random.default_rng(4)
    for m in (2, 5, 12, 30):
        for sides in (None, (np.arange(0, m, 2), np.arange(1, m, 2))):
            hit = np.triu(rng.random((m, m)) < 0.15, 1)
            hit |= hit.T

            def linked(left, right, hit=hit):
                pairs = [(a, b) for k, a in enumerate(left) for b in (left[k + 1 :] if right is None else right) if hit[a, b]]
                return np.array([a for a, _ in pairs], dtype=np.int64), np.array([b for _, b in pairs], dtype=np.int64)

            a, b = buckets._forest_pairs(m, linked, sides)
            i, j = np.nonzero(hit) if sides is None else np.nonzero(hit & ((np.arange(m)[:, None] + np.arange(m)) % 2 == 1))
            got, want = buckets.find_roots(a, b, m), buckets.find_roots(i, j, m)
            assert all(len(set(got[want == r])) == 1 for r in set(want)) and hit[a, b].all()


def test_pruning_keeps_what_may_reach_the_threshold():
    least = buckets.least_matches(0.8, 200)
    assert list(least) == list(range(20, 201, 20))
    assert all(m < 0.8 * t for t, m in least.items()) and least[200] > 100


# quality


def test_quality_counts_equal_brute_force(make):
    rows = DOCS + [(40, "a b c d e f g h " * 5), (41, "x\nx\n\n x\nx"), (42, "#$ %& |<> *"), (43, " ".join(WORDS[:30]) + " " + " ".join(WORDS[5:20]))]
    for r in quality.quality(make(rows, clash=("n_words", "kept"))).collect():
        text = dict(rows)[r.doc_id]
        w = _words(text)
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        covered = {x for own in at.values() if len(own) > 1 for k in own for x in range(k, k + 8)}
        lines = [x for x in (text or "").split("\n") if _words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert r.kept == (not r.base_failed and r.failed_rules == "")


def test_quality_filter_is_not_repeated_in_the_plan(make):
    kept = quality.quality(make(DOCS)).where("kept").select("doc_id")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2 or plan.count("array_distinct") <= 3


# embeddings


def test_every_length_has_a_grid(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LENGTHS", 1)  # grids in turns, as with very many lengths
    grids, deal = [], embedding_dedup._deal
    monkeypatch.setattr(embedding_dedup, "_deal", lambda own: grids.append({d: g.codes for d, g in own.items()}) or deal(own))
    rng, rows = np.random.default_rng(4), []
    for dim, n in ((8, 601), (12, 600), (5, 20), (1, 3)):
        centres = rng.standard_normal((40, dim))
        x = centres[rng.integers(0, 40, n)] + 0.02 * rng.standard_normal((n, dim))
        rows += [(len(rows) + k, v) for k, v in enumerate(x.tolist())]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<double>, label int"), sample=400)
    links = {r.vec_id: r.n_links for r in got.collect()}
    assert grids == [{8: 3}, {12: 3}, {}]
    want = {}
    for dim in (8, 12, 5, 1):
        own = [(k, v) for k, v in rows if len(v) == dim]
        x = np.array([v for _, v in own])
        x /= np.linalg.norm(x, axis=1)[:, None]
        want |= dict(zip([k for k, _ in own], ((x @ x.T >= 0.98).sum(1) - 1).tolist(), strict=True))
    assert set(links) == set(want) and all(links[k] <= want[k] for k in want)
    assert sum(links.values()) >= 0.99 * sum(want.values())



def _unit(rng, n, d=16):
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = _unit(rng, 300)
    near = base[:40].repeat(5, axis=0) + 0.02 * rng.standard_normal((200, 16))
    x = np.concatenate([base, near, near[:3]])
    rows = [(k, [float(v) for v in y], k % 3 if k < 300 else int((k - 300) // 5 % 3)) for k, y in enumerate(x)]
    rows[500:503] = [(500 + k, rows[300 + k][1], rows[300 + k][2]) for k in range(3)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [1.0, None] * 8, 1), (905, rows[0][1][:8], 0), (None, rows[7][1], 2), (906, [], 0)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(vectors, codes=6).collect()}
    valid = [(i, np.array(v), y) for i, v, y in rows if y is not None]
    found = true = 0
    for i, v, y in valid:
        n = sum(j != i and y == z and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98 for j, w, z in valid)
        n += i != 7 and y == 2 and (rows[7][1] @ v) / np.linalg.norm(v) / np.linalg.norm(rows[7][1]) >= 0.98 or i == 7
        assert got[i].n_links <= n
        found, true = found + got[i].n_links, true + n
    assert found >= 0.97 * true > 100
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904, 905, 906))
    assert embedding_dedup.near_vectors(vectors.limit(0)).count() == 0
    assert embedding_dedup.near_vectors(vectors.where("label IS NULL")).count() == 1


def test_blocks_of_vectors_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "RESIDENTS", 16)
    monkeypatch.setattr(embedding_dedup, "GUESTS", 40)
    rng = np.random.default_rng(3)
    x = _unit(rng, 1) + 0.01 * rng.standard_normal((150, 16))
    vectors = spark.createDataFrame([(k, [float(v) for v in y], 0) for k, y in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    got = embedding_dedup.near_vectors(vectors, codes=3).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == want.tolist()


def test_vectors_with_one_or_no_id_are_their_own(spark):
    rng = np.random.default_rng(8)
    a, b, c = ([float(v) for v in y] for y in _unit(rng, 3))
    rows = [(None, a), (None, b), (3, a), (4, b), (3, a), (None, c), (None, c), (None, None)]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.near_vectors(vectors).collect()))
    assert got == sorted([(0, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (0, 1, 4, False), (4, 1, 4, True), (0, 1, 0, True), (0, 1, 0, False), (0, 0, 0, True)])


@pytest.mark.parametrize(("n", "codes"), [(1500, 8), (6000, 40)])
def test_recall_of_links_at_the_threshold(spark, n, codes):
    rng = np.random.default_rng(n)
    base = _unit(rng, n, 32)
    side = rng.standard_normal((n // 3, 32))
    side -= (side * base[: n // 3]).sum(1)[:, None] * base[: n // 3]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.9805, 0.999, (n // 3, 1))
    x = np.concatenate([base, cosine * base[: n // 3] + np.sqrt(1 - cosine**2) * side])
    vectors = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    got = np.array([r.n_links for r in embedding_dedup.near_vectors(vectors, codes=codes).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum() >= n // 2


def test_traversal_is_nearest_first():
    rng = np.random.default_rng(4)
    index = embedding_dedup.fit_index(_unit(rng, 500), 8)
    x = _unit(rng, 50)
    a, b = index.distances(x)
    want = (a[:, :, None] + b[:, None, :]).reshape(50, -1).argsort(axis=1, kind="stable")[:, :10]
    assert (index.traverse(x, 10) == want).all()
    assert (index.traverse(x, 1)[:, 0] == index.cells(x)).all()


# archives


def test_index_holds_however_files_are_split(spark, tmp_path):
    table = spark.range(600).selectExpr("id AS page_id", "concat('u', id) AS url", "concat('<p>', sha2(cast(id AS string), 512), repeat(md5(cast(id AS string)), cast(id % 40 AS int))) AS html")
    settings = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxRecordsPerFile": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        archives, index = warc.archive_pages(table.repartition(3), str(tmp_path / "w"), archive_bytes=40_000)
        files = [(r.archive, bytes(r.content)) for r in warc.read_binary(spark, archives).collect()]
        listed = spark.read.parquet(index).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(dict(files)) == len(files) > 3 and len(listed) == 600 and len({r.page_id for r in listed}) == 600
    for r in listed:
        headers, block = warc.read_at(dict(files)[r.archive], r.offset, r.length)
        assert headers["warc-record-id"] == warc.page_urn(r.page_id) and block.endswith(hashlib.md5(str(r.page_id).encode()).hexdigest().encode() * (r.page_id % 40))
    assert warc.round_trip(table.limit(0)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://x/a b\r\nEvil: 1", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "v", "long " * 5000), (6, "w", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "<p>é</p>"), (5, "v", "long " * 5000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("revisit", F.lit("x"))
    archives, index = warc.archive_pages(table, str(tmp_path / "w"), archive_bytes=6000)
    rows = warc.read_records(warc.read_binary(spark, archives)).collect()
    assert len(rows) == len(pages)
    of = {i: h or "" for i, _, h in pages}
    for r in rows:
        raw = of[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), None: ("revisit", 2), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    places = {(r.archive, r.offset, r.length) for r in rows}
    listed = spark.read.parquet(index).collect()
    assert {(r.archive, r.offset, r.length) for r in listed} == places
    content = {r.archive: bytes(r.content) for r in warc.read_binary(spark, archives).collect()}
    for r in listed:
        headers, _ = warc.read_at(content[r.archive], r.offset, r.length)
        assert headers["warc-record-id"] == warc.page_urn(r.page_id) and "evil" not in headers
    assert warc.round_trip(table.limit(0)).count() == 0


def test_members_of_any_size_end_in_zero():
    big = warc.member_of(bytes(17 * 2**20))
    assert big[-1] == 0 and sum(map(len, warc.inflate(big))) == 17 * 2**20
    with pytest.raises(ValueError):
        list(warc.split_records(iter([warc.record_bytes(1, "u", b"abc", None, False)[:-3]])))


# toxicity


def test_toxicity_learns_and_scores_all(spark, make):
    rows = []
    for k in range(900):
        bad = k % 5 == 0
        rows.append((k, prose(k, 40) + (" you blargh zorkface!" if bad and k % 2 else " bl4rgh blargh" if bad else "")))
    rows += [(1000, None), (1001, ""), (None, "zorkface you blargh")]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(900)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    docs = make(rows, clash=("score", "features"))
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [k for k in range(900) if k % 3 == 1]
    assert sum(got[k].predicted == (k % 5 == 0) for k in held) / len(held) > 0.95
    assert got[1000].score == got[1001].score
    nothing = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(docs, nothing).count() == len(rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


# passages


def test_passages_are_found_in_lines_and_inside_them(spark, make):
    rows = [(i, t) for i, t in DOCS] + [(50, prose(61) + "\n" + PASSAGE + "\n" + prose(62))]
    found = paragraph_dedup.repeated_passages(make(rows, clash=("key", "node")).repartition(4))
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r.doc_id].append(r)
    assert set(got) >= {1, 3, 50} and not set(got) & {0, 2, 9, 12, None}
    for doc_id in (3, 50):
        text = dict(rows)[doc_id].encode()
        cut = b" ".join(text[r.start : r.stop] for r in got[doc_id]).decode().split()
        assert len(set(cut) & set(PASSAGE.split())) >= 0.6 * len(set(PASSAGE.split())) and got[doc_id][0].kept_doc_ids == [2]
    left = {r.doc_id: r.text for r in paragraph_dedup.remove_passages(make(rows), found).collect()}
    assert left[2] == dict(rows)[2] and len(left[50]) < len(dict(rows)[50]) and left[4] is None
    assert paragraph_dedup.repeated_passages(make(DOCS).limit(0)).count() == 0


def test_units_of_texts():
    text = (prose(70, 200) + "\n\n a b\n" + prose(71, 30)).encode()
    found = paragraph_dedup.words_of([np.frombuffer(x, np.uint8) for x in (text, b"", b"x y.")])
    own = paragraph_dedup.units(found, shingles.run_hashes(found.hashes, 5), 22)
    assert found.count.tolist() == [len(text.split()), 0, 2]
    assert [(t, n) for t, n, k in zip(own.text, own.n_words, own.kind, strict=True) if k == paragraph_dedup.WHOLE] == [(2, 2)]
    assert int(own.n_words[own.kind == paragraph_dedup.LINE].sum()) == len(text.split()) - 2
    assert own.n_words[own.kind == paragraph_dedup.ANCHOR].max() <= 8 + 15
