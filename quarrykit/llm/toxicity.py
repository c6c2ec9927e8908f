"""Toxicity of documents: boosted trees over dense features of words, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import stored

#: Labelled rows that anything is fitted on at most: shares of it make the lexicon, the trees and the calibration.
SAMPLE = 20_000
#: Entries of the lexicon at most; how many toxic texts an entry must be in, and its least log odds.
ENTRIES, SUPPORT, LEAST_ODDS = 4000, 3, 3.0
PREFIX = 5
NEAR = 5
CUT = 0.7
REMEMBERED = 400_000
EDGES = ".,;:!?\"'()[]{}<>«»„“”‚‘’…-–—*_~|/\\"
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner deines euch euer eure ihr "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Characters that stand for letters in disguised words.
DISGUISES = str.maketrans("013457@$!|", "oieastasil")
FEATURES = (
    "log_words", "hits", "hit_density", "distinct_hits", "prefix_hits", "prefix_density", "strongest", "odds_density",
    "hidden_hits", "near_second_person", "second_person_density", "capital_words", "capitals", "exclamations", "questions", "disguised",
)
_WORD, _PREFIX, _SECOND, _DISGUISED, _HIDDEN, _CAPITAL = (1 << k for k in range(6))


class _Kinds(dict):
    """What a raw word is, as flags, with hundredths of its log odds above them; worked out once a word."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        word = raw.lower().strip(EDGES)
        flags, odds = 0, 0.0
        if word in self.lexicon:
            flags, odds = flags | _WORD, self.lexicon[word]
        start = word[:PREFIX] + "*"
        if len(word) > PREFIX and start in self.lexicon:
            flags, odds = flags | _PREFIX, max(odds, self.lexicon[start])
        if word in SECOND_PERSON:
            flags |= _SECOND
        if any(c.isalpha() for c in word) and not word.isalpha() and any(not c.isalnum() and c not in "-'’" or c.isdigit() for c in word):
            flags |= _DISGUISED
            plain = word.translate(DISGUISES)
            plain = "".join(c for c in plain if c.isalpha())
            if plain != word and plain in self.lexicon:
                flags, odds = flags | _HIDDEN, max(odds, self.lexicon[plain])
        if len(word) > 1 and raw.isupper():
            flags |= _CAPITAL
        found = self[raw] = flags | int(100 * odds) << 8
        return found


def features(text: str | None, kinds: _Kinds) -> list[float]:
    """The values of ``FEATURES``; zeros for null and empty texts and texts without words."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    known = np.fromiter(map(kinds.__getitem__, words), dtype=np.int64, count=len(words))
    n = len(words)
    odds = (known >> 8) / 100
    hit, prefix, hidden = known & _WORD > 0, known & _PREFIX > 0, known & _HIDDEN > 0
    any_hit = hit | prefix | hidden
    second = np.flatnonzero(known & _SECOND)
    places = np.flatnonzero(any_hit)
    near = 0
    if len(second) and len(places):
        at = np.searchsorted(second, places)
        after = np.abs(second[np.minimum(at, len(second) - 1)] - places)
        before = np.abs(second[np.maximum(at - 1, 0)] - places)
        near = int((np.minimum(after, before) <= NEAR).sum())
    distinct = len({words[k].lower().strip(EDGES) for k in places.tolist()})
    size = len(text)
    return [
        log(n + 1), float(hit.sum()), hit.mean(), float(distinct), float(prefix.sum()), prefix.mean(), odds.max(), odds.sum() / n,
        float(hidden.sum()), float(near), len(second) / n, (known & _CAPITAL > 0).mean(), sum(map(str.isupper, words)) / n,
        text.count("!") / size, text.count("?") / size, (known & _DISGUISED > 0).mean(),
    ]


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs. Without trees (one class only, or no labels), every text scores ``base``."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float


def _measured(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` with ``text`` replaced by ``features``."""
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = _Kinds(lexicon)
        for batch in batches:
            yield batch.drop(columns="text").assign(features=[features(t, kinds) for t in batch.text])

    return docs.mapInPandas(measure, ", ".join([*rest, "features array<double>"]))


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct words, and starts of longer ones, of each text."""
    for batch in batches:
        rows = []
        for text, toxic in zip(batch.text, batch.toxic, strict=True):
            words = {w.lower().strip(EDGES) for w in (text or "").split()}
            words |= {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}
            rows += [(w, int(toxic)) for w in words if w]
        yield pd.DataFrame(rows, columns=["word", "toxic"])


def _lexicon(part: DataFrame) -> dict[str, float]:
    n, toxic = part.agg(F.count("*"), F.sum("toxic")).first()
    clean, toxic = n - (toxic or 0), toxic or 0
    counts = part.mapInPandas(_tokens, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean - F.col("n") + F.col("t") + 0.5))
    best = counts.where(F.col("t") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return {r.word: r.odds for r in best.orderBy(F.desc("odds"), "word").limit(ENTRIES).collect()}


def _margin(scored: DataFrame) -> DataFrame:
    return scored.withColumn("margin", vector_to_array("probability")[1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, seed: int = 11) -> ToxicityModel:
    """Fits on ``sample`` labelled rows at most, chosen by a hash of the id, of those where ``usable`` (of ``doc_id``) holds.

    ``labels``: ``doc_id``, ``toxic`` (0 or 1; other and null labels are left out, a row labelled both ways counts as toxic).
    Half of the rows gives the lexicon (words, and starts of words, with high log odds), a third the trees, and the
    rest the calibration, so no part is fitted to its own errors. Only these rows and what is fitted on them meet the driver.
    """
    chosen = labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = stored(chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample), "labelled")
    # the sample's size bounds the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(6)))
    rows = stored(rows, "training")
    lexicon = _lexicon(rows.where("part < 3"))
    measured = stored(_measured(rows.where("part >= 3"), lexicon).select("part", "toxic", array_to_vector("features").alias("features")).coalesce(4), "features")
    n, toxic = chosen.agg(F.count("*"), F.sum("toxic")).first()
    base = (toxic or 0) / n if n else 0.0
    train, held = measured.where("part < 5"), measured.where("part = 5")
    if train.select("toxic").distinct().count() < 2 or held.isEmpty():
        return ToxicityModel(lexicon, None, None, base)
    trees = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=12, maxDepth=4, stepSize=0.3, seed=seed, minInstancesPerNode=5).fit(train)
    scored = _margin(trees.transform(held)).select(F.col("margin"), F.col("toxic").cast("double").alias("label"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(scored)
    return ToxicityModel(lexicon, trees, calibration, base)


def score(docs: DataFrame, model: ToxicityModel, cut: float = CUT) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` for every row of ``docs``; the text alone decides.

    The score is the calibrated probability with a fiftieth of the trees' own, which orders texts that calibration puts on
    one step. Null and empty texts are scored as texts without words. Repeated rows score alike.
    """
    rows = docs.select("doc_id", "text")
    if model.trees is None:
        return rows.select("doc_id", F.lit(float(model.base)).alias("score"), F.lit(int(model.base >= cut)).alias("predicted"))
    found = _margin(model.trees.transform(_measured(rows, model.lexicon).select("doc_id", array_to_vector("features").alias("features"))))
    found = model.calibration.transform(found.select("doc_id", "margin"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.98 * F.col("prediction") + 0.02 * F.col("margin")))
    return found.select("doc_id", value.alias("score")).select("doc_id", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
