"""Labelled rows: the held-out fold and bounded samples for training."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def held_out(folds: int, fold: int) -> Column:
    """Whether a row is in the fold kept from training; a null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> pd.DataFrame:
    """At most ``most`` labelled texts outside the fold, in a hash order of doc_id: doc_id, text, label.

    The label rows are chosen first; that many at most meet the documents.  Of a
    repeated doc_id the smallest text counts, chosen before anything reaches the driver;
    null labels and texts are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        ~held_out(folds, fold) & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("r"))
    return found.select("doc_id", "r.text", "r.label").toPandas().sort_values("doc_id").reset_index(drop=True)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = l2 * np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - l2 * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
