"""Bounded, deterministic samples of labelled documents, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold


def chosen(key: Column, rows: int, size: int) -> Column:
    """About `size` of `rows` rows, by a hash of the key."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(max(1, rows))) < size


def labelled_sample(
    docs: DataFrame, labels: DataFrame, row_id: str, text: str, label: str, size: int
) -> DataFrame:
    """`row_id`, `text`, `label` of about `size` labelled documents (never more than twice as
    many) whose fold is not the held-out one. Labels that are NULL are left out; of several
    labels of an id the largest counts."""
    usable = (
        labels.where(F.col(label).isNotNull() & F.col(row_id).isNotNull() & (fold(F.col(row_id)) != 0))
        .groupBy(F.col(row_id).alias("_sample_id"))
        .agg((F.max(label) > 0).cast("int").alias("_label"))
    )
    picked = usable.where(chosen(F.col("_sample_id"), usable.count(), size)).limit(2 * size)
    return (
        docs.select(F.col(row_id), F.col(text))
        .join(F.broadcast(picked), F.col(row_id) == F.col("_sample_id"))
        .select(row_id, text, "_label")
        .limit(2 * size)
    )


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * x + offset) the probability of y = 1."""
    if len(x) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return 0.0, float(np.log(share / (1 - share)))
    scale = x.std() or 1.0
    design = np.stack([(x - x.mean()) / scale, np.ones_like(x)], axis=1)
    # Targets a little inside 0 and 1 keep the slope finite when the classes do not overlap.
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(design @ w)
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - p))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * x.mean() / scale)
