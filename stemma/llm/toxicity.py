"""Toxicity by gradient-boosted trees over dense features of the whole text, with isotonic calibration.

The lexicon is learned from the labelled rows: words and word beginnings that
toxic texts use and others do not, each with a weight, the lower confidence
bound of its log odds. The features are densities of lexicon hits, hits near a
second person, capitals, punctuation and signs of obfuscation.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.labelled import TRAIN_ROWS, labelled_texts
from stemma.llm.tables import text_or_empty, whole_row
from stemma.session import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
#: Letters with digits or signs inside, as in "w0rd" or "w*rd"; only sought from where a run of letters begins.
MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$*#!|.\-]+[^\W\d_]+[\w@$*]*")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
SHOUTED = re.compile(r"\b[^\W\d_a-zà-ÿ]{3,}\b")
PUNCTUATION = re.compile(r"[!?]")
SIGN = re.compile(r"[^\w\s]")
ASCII_CAPITALS = string.ascii_uppercase.encode()
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
#: Second persons in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos"
    " tú ti tuyo tuya usted ustedes vosotros vuestro".split()
)
PREFIXES = (4, 5, 6)
NEAR = 5
#: Terms whose use in clean texts is counted, the most frequent in toxic texts.
CANDIDATES = 50_000
#: Weight from which a term belongs to the lexicon, the weights from which hits are counted, and that of a strong hit.
LEAST, TIERS, STRONG = 1.5, (2.25, 3.0, 4.0, 5.0), 3.0
TREES, DEPTH, STEP = 20, 3, 0.3
#: Words whose weight a worker remembers.
REMEMBERED = 1 << 17

FEATURES = (
    "strongest", "hits_1", "hits_2", "hits_3", "hits_4", "strong_density", "weighted_density", "hits_near_second_person", "second_person",
    "capitals", "shouted", "punctuation", "signs", "masked", "masked_hits", "stretched", "words",
)


def capitals_in(text: str) -> int:
    """How many characters are upper case, as ``str.isupper`` has it; those of ASCII are counted as bytes."""
    plain = text.encode("ascii", "ignore")
    found = len(plain) - len(plain.translate(None, ASCII_CAPITALS))
    return found if len(plain) == len(text) else found + sum(map(str.isupper, BEYOND_ASCII.findall(text)))


def terms(words: set[str]) -> set[str]:
    """The words and, marked by a leading dot, their beginnings."""
    out = set(words)
    for n in PREFIXES:
        out.update("." + w[:n] for w in words if len(w) >= n)
    return out


def _term_counts(texts: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(term, n): in how many texts a term occurs, summed per batch before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch["text"]:
                seen = terms(set(WORD.findall(text.lower())))
                found.update(seen if wanted is None else seen & wanted)
            yield pd.DataFrame({"term": list(found.keys()), "n": list(found.values())}, columns=["term", "n"])

    counted = texts.select("text").mapInPandas(count, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Weights of the terms that tell toxic texts from others, from rows (text, label)."""
    totals = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    toxic, clean = totals.get(1.0, 0), totals.get(0.0, 0)
    if not toxic or not clean:
        return {}
    frequent = _term_counts(train.where("label = 1"), None).where(F.col("n") >= max(3, toxic // 400))
    inside = {r["term"]: r["n"] for r in frequent.orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    outside = {r["term"]: r["n"] for r in _term_counts(train.where("label = 0"), frozenset(inside)).collect()}
    weights = {}
    for term, a in inside.items():
        b = outside.get(term, 0)
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        weight = odds - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if weight >= LEAST:
            weights[term] = weight
    return weights


class _Weights(dict):
    """The weight of a word: the largest of the word's own and those of its beginnings."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        of = self.lexicon.get
        weight = max(of(word, 0.0), *(of("." + word[:n], 0.0) if len(word) >= n else 0.0 for n in PREFIXES))
        if len(self) < REMEMBERED:
            self[word] = weight
        return weight


def features(text: str, weights: _Weights) -> list[float]:
    """The features of one text, in the order of FEATURES; an empty text has zeros."""
    lower = text.lower()
    words = WORD.findall(lower)
    n, chars = max(len(words), 1), max(len(text), 1)
    each = np.fromiter(map(weights.__getitem__, words), float, len(words))
    hits = np.nonzero(each >= STRONG)[0]
    person = np.fromiter(map(SECOND_PERSON.__contains__, words), bool, len(words))
    near = 0
    if len(hits) and person.any():
        at = np.nonzero(person)[0]
        k = np.searchsorted(at, hits)
        gap = np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - hits), np.abs(at[np.maximum(k - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    masked = MASKED.findall(lower)
    unmasked = [w for m in masked for w in (re.sub(r"[^\w]|[\d_]", "", m.translate(UNMASK)), m.replace("*", "").replace(".", ""))]
    capitals = capitals_in(text)
    return [
        float(each.max(initial=0.0)),
        *(math.log1p(int((each >= tier).sum())) for tier in TIERS),
        len(hits) / n,
        float(each.sum()) / n,
        math.log1p(near),
        float(person.sum()) / n,
        capitals / chars,
        len(SHOUTED.findall(text)) / n,
        len(PUNCTUATION.findall(text)) / n,
        len(SIGN.findall(text)) / chars,
        len(masked) / n,
        math.log1p(sum(weights[w] >= STRONG for w in unmasked if w)),
        len(STRETCHED.findall(lower)) / n,
        math.log1p(len(words)),
    ]


def feature_column(text: Column, lexicon: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = _Weights(lexicon)
        for batch in batches:
            yield pd.Series([features(t, weights) for t in batch])

    return extract(text)


@dataclass
class ToxicityModel:
    """Lexicon, trees and calibration; ``trees`` is None where the labels had one class or none."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base_rate: float

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, score): ``row`` is the whole input row as a struct, ``score`` from 0 to 1."""
        rows = docs.select(whole_row(docs), text_or_empty(text_col).alias("text"))
        if self.trees is None:
            return rows.select("row", F.lit(self.base_rate).alias("score"))
        dense = array_to_vector(feature_column(F.col("text"), self.lexicon))
        rows = rows.withColumn("features", dense).drop("text")
        raw = self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])
        if self.calibration is None:
            return raw.select("row", F.col("raw").alias("score"))
        fixed = self.calibration.transform(raw.select("row", "raw"))
        # A trace of the raw score orders what the calibration puts on one step.
        return fixed.select("row", (F.col("calibrated") * (1 - 1e-6) + F.col("raw") * 1e-6).alias("score"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on the labelled documents outside the held-out fold, at most ``rows`` of them, equal texts once.

    Four fifths of them train the lexicon and the trees, one fifth the
    calibration. With a single class, or none, every score is the share of
    toxic labels (0 without labels).
    """
    train = cut_lineage(labelled_texts(docs, labels, "toxic", text_or_empty(text_col), rows))
    seen = {(r["label"], r["cal"]): r["count"] for r in train.groupBy("label", (F.col("part") == 0).alias("cal")).count().collect()}
    total = sum(seen.values())
    rate = sum(n for (label, _), n in seen.items() if label == 1.0) / total if total else 0.0
    if not seen.get((1.0, False)) or not seen.get((0.0, False)):
        return ToxicityModel({}, None, None, rate)
    lexicon = learn_lexicon(train.where("part <> 0"))
    dense = cut_lineage(train.select("label", "part", feature_column(F.col("text"), lexicon).alias("f")))
    dense = dense.select("label", "part", array_to_vector("f").alias("features"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, maxBins=64).fit(dense.where("part <> 0"))
    calibration = None
    if seen.get((1.0, True)) and seen.get((0.0, True)):
        raw = trees.transform(dense.where("part = 0")).select("label", vector_to_array("probability")[1].alias("raw"))
        calibration = IsotonicRegression(featuresCol="raw", predictionCol="calibrated").fit(raw)
    return ToxicityModel(lexicon, trees, calibration, rate)


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(row, score) for every row of ``docs``; ``row`` holds its columns, whatever their names.

    Whole texts are scored. Null texts count as empty and are scored like any
    other; repeated rows get equal scores; an empty table gives an empty
    result. Only the text enters a score.
    """
    return fit_toxicity(docs, labels, text_col, rows).score(docs, text_col)
