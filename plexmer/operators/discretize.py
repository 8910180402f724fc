"""Supervised discretisation of features: Ameva and MDL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _edges(x: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring distinct values."""
    v = np.unique(x)
    return (v[1:] + v[:-1]) / 2


def ameva_score(x: np.ndarray, y: np.ndarray, thresholds: np.ndarray) -> float:
    """Score of closed intervals between thresholds (first and last are the extremes); y: class numbers from 0."""
    classes, k = int(y.max()) + 1, len(thresholds) - 1
    if k < 2 or classes < 2:
        return 0.0
    inside = (x[None, :] >= thresholds[:-1, None]) & (x[None, :] <= thresholds[1:, None])
    table = np.stack([inside[:, y == c].sum(axis=1) for c in range(classes)], 1).astype(float)
    rows, columns = table.sum(axis=1, keepdims=True), table.sum(axis=0, keepdims=True)
    share = np.divide(table**2, rows * columns, out=np.zeros_like(table), where=rows * columns > 0).sum()
    return float(table.sum() * (share - 1) / (k * (classes - 1)))


def ameva(x: np.ndarray, y: np.ndarray, most: int | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """(thresholds, score, states): cuts are added one by one while the best one raises the score."""
    cuts, best = np.array([x.min(), x.max()], float), 0.0
    left = list(_edges(x))
    for _ in range(min(most or len(x), len(x) - 1)):
        scores = [ameva_score(x, y, np.sort(np.append(cuts, c))) for c in left]
        if not scores or max(scores) <= best:
            break
        i = int(np.argmax(scores))
        cuts, best = np.sort(np.append(cuts, left.pop(i))), scores[i]
    return cuts, best, np.maximum(np.searchsorted(cuts, x, "left") - 1, 0)


def _class_entropy(y: np.ndarray) -> tuple[float, int]:
    counts = np.bincount(y)
    p = counts[counts > 0] / max(1, len(y))
    return float(-(p * np.log2(p)).sum()), len(p)


def mdl(x: np.ndarray, y: np.ndarray, most: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, states) by recursive entropy splits accepted by the minimum description length (Fayyad and Irani, 1993)."""
    cuts: list[float] = []

    def split(x: np.ndarray, y: np.ndarray) -> None:
        entropy, k = _class_entropy(y)
        best: tuple | None = None
        for cut in _edges(x):
            low = x <= cut
            (e1, k1), (e2, k2) = _class_entropy(y[low]), _class_entropy(y[~low])
            gain = entropy - (low.mean() * e1 + (1 - low.mean()) * e2)
            if gain > 1e-12 and (best is None or gain > best[0]):
                best = gain, cut, k1 * e1 + k2 * e2
        n = len(x)
        if best is None or len(cuts) >= most:
            return
        needed = (np.log2(n - 1) + np.log2(3.0**k - 2) - k * entropy + best[2]) / n
        if best[0] > (1 if needed < 0 else needed):
            cuts.append(best[1])
            split(x[x <= best[1]], y[x <= best[1]])
            split(x[x > best[1]], y[x > best[1]])

    split(x, y)
    at = np.sort(np.array(cuts, float))
    return at, np.searchsorted(at, x, "right")


METHODS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"ameva": lambda x, y: ameva(x, y)[2], "mdl": lambda x, y: mdl(x, y)[1]}


def discretise(matrix: DataFrame, groups: list[str], method: str = "ameva") -> DataFrame:
    """(kmer_id, vals) -> (kmer_id, states); `groups` has each sample's group.

    Rows are independent.  The kernel costs milliseconds a row, so rows are dealt over
    all shuffle partitions first (adaptive execution would merge so few bytes into one task).
    """
    y, kernel = np.unique(groups, return_inverse=True)[1], METHODS[method]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"kmer_id": frame["kmer_id"], "states": [kernel(np.asarray(v, float), y).tolist() for v in frame["vals"]]})

    width = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return matrix.select("kmer_id", "vals").repartition(width, "kmer_id").mapInPandas(run, "kmer_id bigint, states array<int>")
