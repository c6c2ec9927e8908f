"""Features of the toxicity operator against a version that looks at one word after the other."""

import math

import numpy as np
import pytest

from quarrykit.llm import toxicity

LEXICON = {"blargh": 4.567, "zorkface": 3.001, "blarg*": 3.5, "snirt": 6.0, "it's": 3.2, "tú": 3.9}
VOCABULARY = [
    "plain", "words", "blargh", "BLARGH!", "(Blarghest)", "bl4rgh", "bl@rgh", "5n1rt", "$nirt", "zorkface.", "ZORKFACE", "you", "You,", "yourself", "TÚ", "vosotros",
    "A", "OK", "...", "--", "it's", "it’s", "can't", "2024", "3x", "é!", "ß", "İstanbul", "w" * 500, "?", "!!", "blarg", "snirt-snirt", "x y", "\x1c",
]


def plain(text, lexicon):
    words = (text or "").split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    kinds = {x: [] for x in ("hit", "prefix", "hidden", "second", "disguised", "capital")}
    odds, distinct = [], set()
    for at, raw in enumerate(words):
        word = raw.lower().strip(toxicity.EDGES)
        scores = [0.0]
        disguised = any(c.isalpha() for c in word) and any(c.isdigit() or not (c.isalnum() or c in "-'’") for c in word)
        letters = "".join(c for c in word.translate(toxicity.DISGUISES) if c.isalpha())
        for kind, entry, holds in (("hit", word, True), ("prefix", word[:5] + "*", len(word) > 5), ("hidden", letters, disguised and letters != word)):
            if holds and entry in lexicon:
                kinds[kind].append(at)
                scores.append(lexicon[entry])
                distinct.add(word)
        odds.append(math.floor(100 * max(scores)) / 100)
        kinds["second"] += [at] * (word in toxicity.SECOND_PERSON)
        kinds["disguised"] += [at] * disguised
        kinds["capital"] += [at] * (len(word) > 1 and raw.isupper())
    places = {*kinds["hit"], *kinds["prefix"], *kinds["hidden"]}
    near = sum(any(abs(a - b) <= toxicity.NEAR for b in kinds["second"]) for a in places)
    n = len(words)
    return [
        math.log(n + 1), len(kinds["hit"]), len(kinds["hit"]) / n, len(distinct), len(kinds["prefix"]), len(kinds["prefix"]) / n, max(odds), sum(odds) / n,
        len(kinds["hidden"]), near, len(kinds["second"]) / n, len(kinds["capital"]) / n, sum(w.isupper() for w in words) / n,
        text.count("!") / len(text), text.count("?") / len(text), len(kinds["disguised"]) / n,
    ]


@pytest.mark.parametrize("remembered", [toxicity.REMEMBERED, 3])
def test_features_equal_brute_force(monkeypatch, remembered):
    monkeypatch.setattr(toxicity, "REMEMBERED", remembered)
    rng = np.random.default_rng(12)
    texts = [None, "", " \n\t", *VOCABULARY]
    texts += [" ".join(VOCABULARY[k] for k in rng.integers(0, len(VOCABULARY), int(rng.integers(1, 60)))) for _ in range(400)]
    texts.append(" ".join(VOCABULARY[k] for k in rng.integers(0, len(VOCABULARY), 4000)))
    kinds = toxicity._Kinds(LEXICON)
    found = np.zeros(len(toxicity.FEATURES), dtype=bool)
    for text in texts:
        got, want = toxicity.features(text, kinds), plain(text, LEXICON)
        assert got == pytest.approx(want, abs=1e-9), text
        found |= np.array(got) > 0
    assert found.all()


def test_words_of_a_text_alone_decide(spark):
    rows = [(k, t) for k, t in enumerate(["you BLARGH", None, "", "bl4rgh you", "you BLARGH"])] + [(None, "you BLARGH")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.features) for r in toxicity._measured(docs.repartition(4), LEXICON).collect()), key=repr)
    kinds = toxicity._Kinds(LEXICON)
    assert got == sorted(((i, toxicity.features(t, kinds)) for i, t in rows), key=repr)
