"""Toxic spans by a linear-chain conditional random field over tokens.

Labels say which documents are toxic. Tokens are labelled from them: a token of a toxic document is toxic where its
word or the beginning of its word sets the toxic documents apart. The field learns from these tokens; marginals of its
forward-backward pass give offending offsets and, summed up, the documents' scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelweave.llm.common import SPACE_WORD, merged, pick, texts, type_of
from panelweave.llm.fitting import labelled_sample, logistic, sigmoid

#: Labelled texts of either class in the fit, and the longest text in it: the documented bounds of the sample.
PER_CLASS, MAX_BYTES = 1_500, 32_768
#: Words that a worker's table may hold before it starts anew.
KNOWN = 300_000
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(word: bytes) -> list[str]:
    """The word without marks around it, and its first four and five letters, in lower case."""
    core = word.strip(_EDGE).decode("utf-8", "replace").lower()
    if not core:
        return []
    return ["w" + core] + ["4" + core[:4]] * (len(core) >= 4) + ["5" + core[:5]] * (len(core) >= 5)


def telling(lines: list[tuple[int, list[bytes]]], known: dict[bytes, list[str]], least: int, odds: float) -> set[str]:
    """Features that occur in at least ``least`` surroundings in toxic texts, and ``odds`` times as often as in others.

    An occurrence is told by the words before and after it, and counts once: a text that is copied many times says no
    more than one.
    """
    seen: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
    size = [set(), set()]
    for label, words in lines:
        for before, w, after in zip([b"", *words], words, [*words[1:], b""]):
            place = hash((before, after))
            size[label].add(hash((before, w)))
            for f in known[w]:
                seen[label].setdefault(f, set()).add(place)
    n = [len(s) + 1 for s in size]
    return {f for f, k in seen[1].items()
            if len(k) >= least and math.log((len(k) + 0.5) / n[1]) - math.log((len(seen[0].get(f, ())) + 0.5) / n[0]) >= math.log(odds)}


@dataclass(frozen=True)
class Field:
    """Weights of state toxic over state clean: per feature, a bias, and scores of transitions from state to state."""

    weights: dict[str, float]
    bias: float
    moves: tuple[float, float, float, float]  # clean-clean, clean-toxic, toxic-clean, toxic-toxic, as exponentials
    document: tuple[float, float, float]  # of the largest marginal, the logarithm of their sum plus 1, and an intercept

    def odds(self, word: bytes) -> float:
        get = self.weights.get
        return math.exp(min(max(self.bias + sum(get(f, 0.0) for f in features(word)), -30.0), 30.0))

    def marginals(self, odds: list[float]) -> list[float]:
        """The probability of state toxic at every token, by one pass forward and one backward.

        Both passes carry the ratio of the two states' sums, which neither overflows nor needs scaling.
        """
        cc, ct, tc, tt = self.moves
        forward, r = [], None
        for w in odds:
            r = w if r is None else w * (ct + tt * r) / (cc + tc * r)
            forward.append(r)
        out, b = [0.0] * len(odds), 1.0
        for i in range(len(odds) - 1, -1, -1):
            x = forward[i] * b
            out[i] = x / (1.0 + x)
            x = odds[i] * b
            b = (tc + tt * x) / (cc + ct * x)
        return out

    def document_score(self, marginals: list[float]) -> float:
        a, b, c = self.document
        return sigmoid(a * max(marginals, default=0.0) + b * math.log1p(sum(marginals)) + c)


def train(lines: list[np.ndarray], marks: list[np.ndarray], n_features: int, rounds: int = 30, rate: float = 0.4, ridge: float = 1e-6):
    """Feature weights, bias and the four transition scores that maximise the tokens' conditional likelihood.

    ``lines`` has a (tokens, 3) array of feature numbers per text, ``n_features`` standing for none; ``marks`` the
    tokens' labels. Texts of similar length pass through the recursions together; steps are scaled by past gradients.
    """
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    order = [i for i in order if len(lines[i])]
    groups = [order[k:k + 256] for k in range(0, len(order), 256)]
    theta, first, second = np.zeros(n_features + 5), np.zeros(n_features + 5), np.zeros(n_features + 5)
    theta[n_features] = -2.0
    tokens = sum(len(x) for x in lines) or 1
    for step in range(1, rounds + 1):
        gradient = ridge * tokens * theta / 100
        w, bias, moves = np.append(theta[:n_features], 0.0), theta[n_features], np.exp(theta[n_features + 1:])
        cc, ct, tc, tt = moves
        for own in groups:
            n = np.array([len(lines[i]) for i in own])
            size = int(n[0])
            odds = np.ones((size, len(own)))
            for k, i in enumerate(own):
                odds[:n[k], k] = np.exp(np.clip(bias + w[lines[i]].sum(1), -30, 30))
            alive = [int((n > t).sum()) for t in range(size + 1)]
            ahead, back = np.ones_like(odds), np.ones_like(odds)
            ahead[0] = odds[0]
            for t in range(1, size):
                m = alive[t]
                r = ahead[t - 1, :m]
                ahead[t, :m] = odds[t, :m] * (ct + tt * r) / (cc + tc * r)
            for t in range(size - 2, -1, -1):
                m = alive[t + 1]
                x = odds[t + 1, :m] * back[t + 1, :m]
                back[t, :m] = (tc + tt * x) / (cc + ct * x)
            x = ahead * back
            toxic = x / (1 + x)
            expected, seen = np.zeros(4), np.zeros(4)
            live = np.arange(1, size)[:, None] < n[None, :]
            if live.any():
                x, r = (odds[1:] * back[1:])[live], ahead[:-1][live]
                cells = np.stack([np.full_like(x, cc), ct * x, tc * r, tt * r * x])
                expected = (cells / cells.sum(0)).sum(1)
            for k, i in enumerate(own):
                error = toxic[:n[k], k] - marks[i]
                gradient[n_features] += error.sum()
                gradient[:n_features + 1] += np.bincount(lines[i].ravel(), np.repeat(error, 3), n_features + 1)[:n_features + 1] * _not_last(n_features)
                seen += np.bincount(2 * marks[i][:-1] + marks[i][1:], minlength=4)
            gradient[n_features + 1:] += expected - seen
        gradient /= tokens / 100
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta[n_features + 1:] -= theta[n_features + 1]  # only differences between transitions count
        theta = np.clip(theta, -12, 12)
    return theta[:n_features], float(theta[n_features]), tuple(float(x) for x in np.exp(theta[n_features + 1:]))


def _not_last(n: int) -> np.ndarray:
    out = np.ones(n + 1)
    out[n] = 0.0
    return out


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, least: int = 3, odds: float = 25.0) -> Field:
    """Fit on a bounded sample of the labelled texts, see labelled_sample; four fifths fit the field, one calibrates it.

    Document scores are calibrated with the classes weighed by how often the labels name them. With labels of one
    class only, or none, every text gets the smoothed share of label 1 and no token is toxic.
    """
    sample, counts = labelled_sample(documents, labels, label_col, id_col, text_col, per_class, max_bytes)
    y = np.array([label for label, _ in sample], dtype=int)
    cut = len(sample) // 5
    if min([(part == c).sum() for part in (y[:cut], y[cut:]) for c in (0, 1)]) == 0:
        share = (counts[1] + 1) / (counts[0] + counts[1] + 2)
        return Field({}, -30.0, (1.0, 1.0, 1.0, 1.0), (0.0, 0.0, math.log(share / (1 - share))))
    known: dict[bytes, list[str]] = {}
    words = [text.split() for _, text in sample]
    for line in words:
        for w in line:
            if w not in known:
                known[w] = features(w)
    marked = telling([(label, line) for (label, _), line in zip(sample[cut:], words[cut:])], known, least, odds)
    often = Counter(f for line in words[cut:] for w in set(line) for f in known[w])
    names = {f: i for i, f in enumerate(sorted(f for f, k in often.items() if k >= 5 or f in marked))}
    none = len(names)
    numbers = {w: ([names.get(f, none) for f in fs] + [none] * 3)[:3] for w, fs in known.items()}
    toxic = {w for w, fs in known.items() if any(f in marked for f in fs)}
    lines = [np.array([numbers[w] for w in line], np.int64).reshape(-1, 3) for line in words[cut:]]
    marks = [np.array([int(label and w in toxic) for w in line], np.int64) for (label, _), line in zip(sample[cut:], words[cut:])]
    weights, bias, moves = train(lines, marks, none)
    field = Field({f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-4}, bias, moves, (0.0, 0.0, 0.0))
    cache = {w: field.odds(w) for w in known}
    found = [field.marginals([cache[w] for w in line]) for line in words[:cut]]
    x = np.array([[max(m, default=0.0), math.log1p(sum(m))] for m in found])
    weight = np.array([counts[label] / max(1, (y == label).sum()) for label in y[:cut]])
    a, b, c = logistic(x, y[:cut], weight, ridge=0.1)
    return Field(field.weights, bias, moves, (float(a), float(b), float(c)))


def tag(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: the id, ``score`` (0 to 1) and ``spans``, the code points of toxic tokens.

    Tokens whose marginal is at least ``least`` are toxic; neighbours form one span. Null and empty texts have no
    tokens and get the score of no marginals; no rows give none.
    """
    rows = pick(documents, id=id_col, text=text_col)
    spans_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            scores, spans = [], []
            for text in texts(batch.column(1)):
                words = text.split()
                try:
                    odds = [known[w] for w in words]
                except KeyError:
                    if len(known) > KNOWN:
                        known.clear()
                    for w in words:
                        if w not in known:
                            known[w] = field.odds(w)
                    odds = [known[w] for w in words]
                marginals = field.marginals(odds)
                scores.append(field.document_score(marginals))
                spans.append(_spans(text, marginals, least) if marginals and max(marginals) >= least else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, spans_of)], names=["id", "score", "spans"])

    kind = f"id {type_of(rows, 'id')}, score double, spans array<struct<start:int,end:int>>"
    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def _spans(text: bytes, marginals: list[float], least: float) -> list[dict[str, int]]:
    at = [m.span() for m in SPACE_WORD.finditer(text.decode("utf-8", "replace"))]
    ranges = merged([(i, i + 1) for i, p in enumerate(marginals) if p >= least])
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]
