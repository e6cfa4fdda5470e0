"""Quality classifier by positive-unlabelled learning.

The model is a small network on about twenty shapes of a text.  It minimises the non-negative unbiased risk of
positive-unlabelled learning: trusted positives are documents labelled 1, the unlabelled side is web text whose labels
are not looked at, and the class prior is estimated as the share of 1 among the labelled rows learned from.  Shapes are
computed where the texts are; only the shapes of two bounded samples reach the driver, where the network is fitted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vantage.llm.common import fold

NAMES = (
    "upper", "digit", "space", "lines", "symbols", "tails", "bars", "beyond_ascii", "word_length", "long_words", "distinct", "repeats",
    "line_repeats", "letters", "sentence_ends", "packed", "chars", "words", "same_byte", "digits_or_marks",
)
SYMBOLS = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'-?" for b in range(256)])
ENDS = frozenset("#$%&*!+=~^@|")


def shape(text: str | None) -> list[float]:
    """The numbers of NAMES; all finite, zeros for null, empty and blank texts."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(NAMES)
    raw, n, w = text.encode(), len(text), len(words)
    count, size = np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(raw)
    upper = int(count[65:91].sum())
    letters = upper + int(count[97:123].sum()) + int(count[128:].sum())
    symbols, digits = int(count[SYMBOLS].sum()), int(count[48:58].sum())
    lines, low = [x for x in text.split("\n") if x], text.lower().split()
    return [
        upper / max(letters, 1), digits / size, count[32] / size, count[10] / w, symbols / size, sum(x[-1] in ENDS for x in words) / w, count[124] / w,
        (size - n) / n, min(n / w, 40) / 10, sum(len(x) > 20 for x in words) / w, len(set(low)) / w, sum(map(str.__eq__, low, low[1:])) / w,
        1 - len(set(lines)) / max(len(lines), 1), letters / size, (count[46] + count[63]) / w, min(len(zlib.compress(raw, 1)) / size, 1.5),
        np.log1p(n) / 10, np.log1p(w) / 10, count.max() / size, (digits + symbols) / size,
    ]


def shapes(text: Column) -> Column:
    @pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shape(t) for t in texts], dtype=object)

    return run(text)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(self.inputs(x) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 800, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Model:
    """The network of least non-negative unbiased risk, with the sigmoid loss.

    Risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).  While the second part is below 0 its gradient is turned round.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    scale = both.std(axis=0)
    model = Model(both.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), [])
    model.layers = [rng.normal(0, both.shape[1] ** -0.5, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    x = model.inputs(both)
    p, n_p, n_u = slice(0, len(positive)), len(positive), len(unlabelled)
    first, second = [np.zeros_like(v) for v in model.layers], [np.zeros_like(v) for v in model.layers]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = model.layers
        h = np.tanh(x @ w1 + b1)
        s = _sigmoid(h @ w2 + b2)  # loss of calling it negative; 1 - s of calling it positive
        slope = s * (1 - s)
        negative = s[n_p:].mean() - prior * s[p].mean()
        g = np.empty(len(x))
        if negative >= 0:
            g[p], g[n_p:] = -2 * prior * slope[p] / n_p, slope[n_p:] / n_u
        else:
            g[p], g[n_p:] = prior * slope[p] / n_p, -slope[n_p:] / n_u
        dh = g[:, None] * w2 * (1 - h * h)
        grads = [x.T @ dh + decay * w1, dh.sum(axis=0), h.T @ g + decay * w2, np.array([g.sum()])]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            model.layers[i] = model.layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def _sampled(docs: DataFrame, ids: DataFrame, bound: int, id_col: str, text_col: str) -> np.ndarray:
    """Shapes of the `bound` ids of least hash, one row of each (the least text)."""
    chosen = ids.select(F.col("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(bound)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    once = text.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"))
    rows = once.select(shapes(F.col("text")).alias("x")).collect()
    return np.array([r["x"] for r in rows]).reshape(-1, len(NAMES))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held: int = 0, folds: int = 5, bound: int = 6000) -> Model | None:
    """Learns from documents outside fold `held`: at most `bound` positives and `bound` unlabelled ones (a documented bound).

    Labels of the held fold, null labels and null ids are not used.  None if there are no positives or no documents.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where((fold(F.col("id"), folds) != held) & F.col("label").isNotNull())
    prior = own.agg(F.avg(F.col("label").cast("double"))).first()[0]
    if not prior:
        return None
    positive = _sampled(docs, own.where("label = 1"), bound, id_col, text_col)
    free = docs.select(F.col(id_col).alias("id")).where(fold(F.col("id"), folds) != held)
    unlabelled = _sampled(docs, free, bound, id_col, text_col)
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, float(min(max(prior, 0.02), 0.98)))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", into: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of each whole text; without a model 0.5.  Null and empty texts are scored as blank."""
    if model is None:
        return docs.withColumn(into, F.lit(0.5))

    @pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([shape(t) for t in texts]).reshape(-1, len(NAMES))
            yield pd.Series(model.score(x))

    return docs.withColumn(into, run(F.col(text_col)))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per input row.

    Only texts enter a score.  Null and empty texts get the score of a blank text; null ids count as held out; repeated
    rows stay; other columns are ignored; an empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col)
    rows = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return rows.select(
        "doc_id", F.when(F.col("doc_id").isNull(), True).otherwise(fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents not rejected, whole rows, all columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels, id_col, text_col), text_col, name).where(F.col(name) >= threshold).drop(name)
