"""Quality scores learned from preference pairs (Bradley-Terry).

Each pair holds one document labelled good and one labelled bad; the model is
the logistic loss on the difference of their features. A document's latent
score is the weighted sum of its features, and the cut is a quantile of the
training scores. Features describe the whole text: kinds of characters, word
shapes, repetition, and the worst stretch of words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.llm.common import Remember, split_words
from haplolake.llm.sampling import labelled_sample

SHAPES, STRETCH = 64, 50
PER_CLASS, PAIRS = 2000, 20_000
CUT = 0.3  # the score at which a document is accepted

# Kinds of words counted over the text and over its worst stretch.
_SHOUTED, _MARKED, _BARE, _KINDS = 1, 2, 4, 3


def _describe(word: str) -> tuple[int, int]:
    """Bucket of the word's shape, and the kinds it belongs to."""
    shape, last = [], ""
    letters = upper = 0
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        letters += k in "Aa"
        upper += k == "A"
        if k != last:
            shape.append(k)
            last = k
    kinds = _SHOUTED * (upper >= 2 and upper == letters) + _MARKED * (letters > 0 and len(word) - letters >= 2) + _BARE * (letters == 0)
    return zlib.crc32("".join(shape).encode("utf-8", "surrogatepass")) % SHAPES, kinds


_words = Remember(_describe, 150_000)
N_FEATURES = SHAPES + 2 * (_KINDS + 1) + 6


def features(text: str | None) -> np.ndarray:
    """Feature vector of a whole text; NULL and empty texts have the zero vector."""
    out = np.zeros(N_FEATURES)
    words = split_words(text)
    n = len(words)
    if not n:
        return out
    described = [_words[w] if len(w) <= 64 else _describe(w) for w in words]
    shape, kinds = np.array(described, np.int64).T
    out[:SHAPES] = np.sqrt(np.bincount(shape, minlength=SHAPES) / n)
    again = np.zeros(n, np.int64)
    again[1:] = [a == b for a, b in zip(words, words[1:], strict=False)]
    flags = np.stack([(kinds & k > 0).astype(np.int64) for k in (_SHOUTED, _MARKED, _BARE)] + [again])
    out[SHAPES : SHAPES + 4] = flags.mean(1)
    running = np.concatenate([np.zeros((4, 1), np.int64), flags.cumsum(1)], 1)
    width = min(n, STRETCH)
    out[SHAPES + 4 : SHAPES + 8] = (running[:, width:] - running[:, :-width]).max(1) / width
    lines = text.split("\n")
    letters = sum(map(len, words))
    out[SHAPES + 8 :] = [
        len(set(words)) / n, len(set(lines)) / len(lines), letters / n / 10, np.log1p(n) / 10, np.log1p(max(map(len, words))) / 10, 1.0,
    ]
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights on scaled features, and the latent score at the cut."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1 in the latent order, with the cut at ``CUT``."""
        z = self.latent(x) - self.cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 5) -> Ranking:
    """Newton's method on the pairwise logistic loss.

    Without both classes there is no pair: the weights are zero, every document
    scores above the cut and is accepted.
    """
    mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
    scale = np.maximum(x.std(0), 1e-2) if len(x) else np.ones(N_FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(N_FEATURES), mean, scale, -1.0)
    rng, z = np.random.default_rng(seed), (x - mean) / scale
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(N_FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # chance that the bad one wins
        gradient = ridge * w - d.T @ p
        hessian = ridge * np.eye(len(w)) + (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    scores = np.sort(z @ w)
    at = len(bad)  # the quantile that rejects as many as are labelled bad
    cut = (scores[at - 1] + scores[min(at, len(scores) - 1)]) / 2
    return Ranking(w, mean, scale, float(cut))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Ranking:
    """Ranking from up to ``per_class`` labelled documents of each class outside the held-out fold."""

    @F.pandas_udf("array<double>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t) for t in texts], dtype=object)

    sample = labelled_sample(docs, labels, "quality", per_class)
    rows = sample.select("doc_id", "y", described("text").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    x = np.stack(rows["x"].tolist()) if len(rows) else np.empty((0, N_FEATURES))
    return fit(x, rows["y"].to_numpy(dtype=np.int64))


def quality_score(text: Column, model: Ranking) -> Column:
    """Score of each whole text, from 0 to 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.stack([features(t) for t in texts])) if len(texts) else [], dtype=float)

    return run(text)


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from a score of 0.3 on) to every document.

    NULL and empty texts are scored as texts without features. Repeated rows
    score alike. An empty table stays empty. Columns of these names are replaced;
    labels, lang, source and doc_id are no inputs of a score.
    """
    model = fit_quality(docs, labels, per_class)
    scored = docs.withColumn("score", quality_score(F.col("text"), model))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
