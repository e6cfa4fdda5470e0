"""Language identification with a convolutional network over bytes.

A text is cut into windows of `LENGTH` bytes, the last one filled with zeros.  Filters of several widths run over a
window's bytes (a filter is a table of weights for each byte and place), each is pooled to its maximum, and a softmax
layer gives the languages.  The network is trained in numpy on windows of a bounded sample of labelled texts and applied
to all windows of all texts in batches; the windows' log probabilities are averaged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vantage.llm.common import fold

LENGTH, WIDTHS = 192, (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


def windows(text: str) -> np.ndarray:
    """All bytes of a text in rows of LENGTH; no row for the empty text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros((-(-len(raw) // LENGTH), LENGTH), np.uint8)
    out.reshape(-1)[:len(raw)] = raw
    return out


@dataclass
class ByteNet:
    languages: list[str]
    filters: int = 16
    seed: int = 9
    tables: list[np.ndarray] = field(default_factory=list)  # for each width: places x 256 bytes x filters
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def __post_init__(self) -> None:
        if not self.tables:
            rng = np.random.default_rng(self.seed)
            self.tables = [rng.normal(0, 0.3 / w**0.5, (w, 256, self.filters)).astype(np.float32) for w in WIDTHS]
            size = self.filters * len(WIDTHS)
            self.bias = np.zeros(size, np.float32)
            self.out = rng.normal(0, size**-0.5, (size, len(self.languages))).astype(np.float32)
            self.out_bias = np.zeros(len(self.languages), np.float32)

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter in each window, and where it is."""
        best, at = [], []
        for width, table in zip(WIDTHS, self.tables, strict=True):
            n = LENGTH - width + 1
            y = table[0].take(x[:, :n], axis=0)
            for j in range(1, width):
                y += table[j].take(x[:, j:j + n], axis=0)
            best.append(y.max(axis=1))
            if places:
                at.append(y.argmax(axis=1))
        return np.maximum(np.concatenate(best, axis=1) + self.bias, 0), at

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x)[0] @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01) -> ByteNet:
        rng = np.random.default_rng(self.seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, f = 0, np.arange(self.filters)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for start in range(0, len(x), batch):
                take = order[start:start + batch]
                own, target = x[take], y[take]
                h, at = self.pooled(own, places=True)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(own)), target] -= 1
                p /= len(own)
                dh = (p @ self.out.T) * (h > 0)
                grads = []
                for i, table in enumerate(self.tables):
                    grad = np.zeros_like(table)
                    part = dh[:, i * self.filters:(i + 1) * self.filters]
                    for j in range(WIDTHS[i]):
                        np.add.at(grad[j], (np.take_along_axis(own, at[i] + j, axis=1), f[None, :]), part)
                    grads.append(grad)
                grads += [dh.sum(axis=0), h.T @ p, p.sum(axis=0)]
                step += 1
                for k, (param, grad) in enumerate(zip(params, grads, strict=True)):
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    param -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None], batch: int = 256) -> tuple[list[str], list[float]]:
        """Language and probability of whole texts; windows of many texts share a batch."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        sums, held = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        rows, owner, n = [], [], 0

        def flush() -> None:
            logs, of = self.log_probabilities(np.concatenate(rows)), np.concatenate(owner)
            np.add.at(sums, of, logs)
            np.add.at(held, of, 1)
            rows.clear()
            owner.clear()

        for i, text in enumerate(texts):
            if not text or not LETTER.search(text):
                continue
            all_rows = windows(text)
            for start in range(0, len(all_rows), batch):
                part = all_rows[start:start + batch]
                rows.append(part)
                owner.append(np.full(len(part), i))
                n += len(part)
                if n >= batch:
                    flush()
                    n = 0
        if rows:
            flush()
        for i in np.flatnonzero(held):
            mean = sums[i] / held[i]
            best = int(mean.argmax())
            names[i], scores[i] = self.languages[best], float(np.exp(mean[best]) / np.exp(mean).sum())
        return names, scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = 2, folds: int = 4, bound: int = 2500, per_text: int = 4, each: int = 50) -> ByteNet | None:
    """Learns from documents outside fold `held` with a language, `per_text` windows spread over each whole text.

    At most `bound` documents (those of least hash) and besides, so that no language is left out, at most `each` of every
    language (documented bounds); repeated rows of an id and language count once, with the least text.

    None if there are no such documents.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.where((fold(F.col("id"), folds) != held) & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    @pandas_udf("array<binary>")
    def some(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                rows = windows(text)
                out.append([rows[i].tobytes() for i in np.unique(np.linspace(0, len(rows) - 1, per_text).astype(int))])
            yield pd.Series(out, dtype=object)

    every = own.select("id", "lang").distinct()
    drawn = every.orderBy(F.xxhash64("id"), "id", "lang").limit(bound)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = drawn.unionAll(every.withColumn("place", place).where(F.col("place") <= each).drop("place")).distinct()
    once = own.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    rows = sorted((r["id"], r["lang"], r["x"]) for r in once.select("id", "lang", some("text").alias("x")).collect())
    if not rows:
        return None
    languages = sorted({lang for _, lang, _ in rows})
    x = np.array([np.frombuffer(w, np.uint8) for _, _, ws in rows for w in ws])
    y = np.array([languages.index(lang) for _, lang, ws in rows for _ in ws])
    return ByteNet(languages).train(x, y)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per input row.

    Only texts enter a prediction.  A null text or one without a letter is `und` with score 0, so is every text if
    nothing could be learned; null ids are never learned from (their fold is that of the empty text); repeated rows
    stay; other columns are ignored; an empty table gives no rows.
    """
    model = train(docs, id_col, text_col, lang_col)

    @pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = model.predict(texts.tolist()) if model else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    rows = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("x"))
    return rows.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "x.lang_pred", "x.score")
