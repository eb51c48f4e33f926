"""Quality classifier: naive Bayes support vectors over n-grams of words and of word shapes.

Indicators of n-grams are scaled by their log-count ratio between the classes, and a linear hinge-loss model is fitted
to them by dual coordinate descent. N-grams are hashed into a fixed number of columns, so the model's size is fixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from panelweave.llm.common import lean, pick, texts, type_of
from panelweave.llm.fitting import labelled_sample, logistic, sigmoid

#: N-grams are hashed into 2 ** BITS columns.
BITS = 18
#: Labelled texts of either class in the fit, and the longest text in it: the documented bounds of the sample.
PER_CLASS, MAX_BYTES = 2_048, 32_768
#: Words that a worker's table may hold before it starts anew.
KNOWN = 300_000
_CLASSES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1\1+", re.S)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shape(word: bytes) -> bytes:
    """The word with letters as A or a and digits as 0; longer runs count as two."""
    return _RUN.sub(rb"\1\1", word.translate(_CLASSES))


class Grams:
    """Hashed n-grams of a text: words, pairs of words, pairs of shapes, and whether neighbours are equal."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.word, self.shape = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def _index(self, words: list[bytes]) -> np.ndarray:
        at = self.at
        try:
            return np.fromiter([at[w] for w in words], np.int64, len(words))
        except KeyError:
            if len(at) > KNOWN:
                self._reset()
                at = self.at
            for w in words:
                if w not in at:
                    i = at[w] = len(at)
                    if i == len(self.word):
                        self.word, self.shape = np.resize(self.word, 2 * i), np.resize(self.shape, 2 * i)
                    self.word[i] = xxhash.xxh3_64_intdigest(w.lower())
                    self.shape[i] = xxhash.xxh3_64_intdigest(shape(w), 1)
            return np.fromiter([at[w] for w in words], np.int64, len(words))

    def columns(self, text: bytes) -> np.ndarray:
        """Distinct columns of the text's n-grams, sorted; none for a text without words."""
        i = self._index(text.split())
        if not len(i):
            return np.zeros(0, np.int32)
        w, s = self.word[i], self.shape[i]
        same = (w[1:] == w[:-1]).astype(np.uint64)
        with np.errstate(over="ignore"):
            grams = np.concatenate([w * _M1, (w[:-1] * _M2 ^ w[1:]) * _M1, (s[:-1] * _M3 ^ s[1:]) * _M2, ((s[1:] ^ _M1) * _M2 + same) * _M3])
        return np.unique((grams >> np.uint64(64 - BITS)).astype(np.int32))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def score(self, columns: np.ndarray) -> float:
        margin = self.bias + (float(self.weights[columns].sum()) / len(columns) ** 0.5 if len(columns) else 0.0)
        return sigmoid(self.slope * margin + self.intercept)


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear hinge-loss model by dual coordinate descent.

    A row's value in its columns is the column's ratio over the root of the row's number of columns; ``cost`` bounds
    each row's dual variable.
    """
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = [ratio[c] / max(1, len(c)) ** 0.5 for c in rows]
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            c, v, sign = rows[i], values[i], 1.0 if y[i] else -1.0
            slope = sign * (float(w[c] @ v) + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign
                w[c] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, cost: float = 1.0) -> Model:
    """Fit on a bounded sample of the labelled texts, see labelled_sample; four fifths fit the model, one calibrates it.

    Calibration weighs the classes by how often the labels name them. With labels of one class only, or none, the
    score is the smoothed share of label 1 for every text.
    """
    sample, counts = labelled_sample(documents, labels, label_col, id_col, text_col, per_class, max_bytes)
    y = np.array([label for label, _ in sample], dtype=int)
    own = y[len(y) // 5:]
    if not len(own) or own.min() == own.max() or min((y[:len(y) // 5] == c).sum() for c in (0, 1)) == 0:
        share = (counts[1] + 1) / (counts[0] + counts[1] + 2)
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    grams = Grams()
    rows = [grams.columns(text) for _, text in sample]
    cut = len(rows) // 5
    seen = np.ones((2, 1 << BITS))
    for c, label in zip(rows[cut:], own):
        seen[label, c] += 1
    ratio = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    balance = np.array([len(own) / (2 * (own == c).sum()) for c in (0, 1)])
    w, bias = descend(rows[cut:], own, ratio, cost * balance[own])
    w = w * ratio
    margin = np.array([bias + (w[c].sum() / len(c) ** 0.5 if len(c) else 0.0) for c in rows[:cut]])
    weight = np.array([counts[label] / max(1, (y == label).sum()) for label in y[:cut]])
    slope, intercept = logistic(margin[:, None], y[:cut], weight)
    return Model(w, float(bias), float(slope), float(intercept))


_GRAMS = None


def scores(model: Model, column: pa.Array) -> list[float]:
    global _GRAMS
    _GRAMS = _GRAMS or Grams()
    return [model.score(_GRAMS.columns(text)) for text in texts(column)]


def forget() -> None:
    """Drop the worker's table of words: it lives on between tasks, and what every worker of an executor kept would add up."""
    global _GRAMS
    _GRAMS = None


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``score``, from 0 to 1, higher where label 1 is likelier.

    Null and empty texts get the score of a text without n-grams; no rows give none.
    """
    rows = pick(documents, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, batch.column(1)), pa.float64())], names=["id", "score"])
        finally:
            forget()

    return rows.mapInArrow(lean(run), f"id {type_of(rows, 'id')}, score double").withColumnRenamed("id", id_col)


def keep_good(documents: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``least``.

    Null and empty texts score like a text without words, repeated rows alike; no rows give no rows.
    """
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                yield batch.filter(pa.array([s >= least for s in scores(model, batch.column(at))], pa.bool_()))
        finally:
            forget()

    return documents.mapInArrow(lean(run), documents.schema)
