"""What the fitted classifiers share: a bounded sample of labelled texts and the calibration of scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import pick


def fold(key: Column, of: int) -> Column:
    """The fold of a record: crc32 of its id as text, modulo ``of``; a null id has fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(of)).cast("int")


def labelled_sample(documents: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_class: int,
                    max_bytes: int) -> tuple[list[tuple[int, bytes]], dict[int, int]]:
    """Texts with their label, and how many records carry each label.

    Up to ``per_class`` ids of either label, those with the smallest hashes, are looked up in the documents; texts of
    more than ``max_bytes`` are left out of the fit, and of several rows with one id one stays. Labels that are null,
    not 0 or 1, or that contradict each other for one id are not used. What reaches the driver is bounded by
    ``2 * per_class * max_bytes``.
    """
    known = pick(labels, id=id_col, label=label_col).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where(F.col("label") == F.col("most"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        own = known.where(F.col("label") == value).select("id", "label").orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = pick(documents, id=id_col, text=F.coalesce(documents[text_col].cast("string"), F.lit("")))
    rows = rows.where(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "id")  # at most 2 * per_class ids
    rows = rows.groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    found = sorted((r["id"], r["label"], r["text"].encode()) for r in rows.collect())
    order = np.random.default_rng(5).permutation(len(found))
    return [found[i][1:] for i in order], {0: counts.get(0, 0), 1: counts.get(1, 0)}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last one is the intercept, which is not shrunk.

    Targets are moved off 0 and 1 as for calibration, so that separable samples give finite weights.
    """
    x = np.column_stack([x, np.ones(len(x))])
    most, least = max(1.0, weight[y == 1].sum()), max(1.0, weight[y == 0].sum())
    target = np.where(y == 1, (most + 1) / (most + 2), 1 / (least + 2))
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + keep, x.T @ (weight * (p - target)) + keep @ w)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -35.0), 35.0)))
