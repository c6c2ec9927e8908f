"""The pipeline, stage by stage, against plain versions on the smallest documents."""

import collections

import pytest

from tests.llm.test_operators import _sets, _without_repeats

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_version(spark):
    from tokenizers import Tokenizer

    from quarrykit.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    names = list(stage)
    kept = stage[names[0]](spark, docs, SMALL)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    # near duplicates: the smallest of each component stays
    sets, parent = {i: _sets(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    single = stage[names[1]](spark, kept, SMALL)
    left = {r.doc_id: r.text for r in single.collect()}
    assert set(left) == {i for i in ids if find(i) == i}
    # repeated strings
    want = _without_repeats(list(left.items()))
    cleaned = {r.doc_id: r for r in stage[names[2]](spark, single, SMALL).collect()}
    assert set(cleaned) == {i for i, (n, gone, _, _) in want.items() if gone == 0 or gone < n}
    assert all(len(r.text) == r.n_chars for r in cleaned.values())
    # the whole: every copy's pieces are there once, and sequences hold no gap
    packed = corpus_pipeline.run(spark, SMALL).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    sizes = collections.Counter()
    for r in packed:
        sizes[r.doc_id, r.piece] += 1
    assert {i for i, _ in sizes} <= set(cleaned)
    for i in {i for i, _ in sizes}:
        n = len(tokenizer.encode(cleaned[i].text, add_special_tokens=False).ids) + 1
        assert {p for j, p in sizes if j == i} == set(range(-(-n // 4096)))
    sequences = collections.defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


PROSE = [f"the rain{k} of a{k} day{k} is to fall{k} and we{k} see{k} that it was wet{k} in town{k}" for k in range(4000)]
ROWS = [
    (1, " ".join(PROSE[:3])), (1, " ".join(PROSE[:3])), (2, " ".join(PROSE[:3])), (None, " ".join(PROSE[10:13])), (None, " ".join(PROSE[20:23])),
    (3, None), (4, ""), (5, "too short"), (6, "\n".join(PROSE[30:3000])), (7, PROSE[40] + " " + " ".join(PROSE[3001:3004])), (8, "\x00 \u00e9 " + " ".join(PROSE[3010:3013])),
]


def test_stages_take_nulls_repeats_and_clashing_columns(spark, make):
    clash = ("n_words", "kept", "row", "_row", "copies", "n_removed", "failed_rules", "piece")
    docs = make(ROWS, clash=clash)
    stage, kept = dict(corpus_pipeline.STAGES), {}
    for name in list(stage)[:-1]:
        out = stage[name](spark, docs, SMALL)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        assert all(r[c] == "x" for r in docs.collect() for c in clash) and all(r.n_chars == len(r.text) for r in docs.collect())
    by_id = [[i for i, _ in rows] for rows in kept.values()]
    # rejected: null, empty and short texts; long and odd ones and every row of a repeated or missing id stay
    assert sorted(by_id[0], key=str) == sorted([1, 1, 2, None, None, 6, 7, 8], key=str)
    # equal texts: one row of the smallest id
    assert sorted(by_id[1], key=str) == sorted([1, None, None, 6, 7, 8], key=str)
    # strings that document 6 has go from document 7
    assert sorted(by_id[2], key=str) == sorted(by_id[1], key=str)
    seventh = dict((i, t) for i, t in kept["suffix-array dedup"] if i == 7)[7]
    assert seventh == dict(ROWS)[7].replace(PROSE[40], "", 1) or len(seventh) < len(dict(ROWS)[7])
    # copies are of these alone
    assert set(kept["source mix"]) <= set(kept["suffix-array dedup"])
    packed = stage["best-fit packing"](spark, docs, SMALL).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(i for i, _ in kept["source mix"])
    assert all(r.length <= 4096 for r in packed)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "short")]])
def test_stages_of_nothing(spark, make, rows):
    """An empty table, and one that the first stage empties, go through all stages."""
    docs = make(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == make([]).columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 0
