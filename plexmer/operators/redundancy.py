"""Hamming distances, and greedy removal of redundant features within buckets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows whose pairs are counted in one product.
BLOCK = 128


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def _bits(counts: np.ndarray) -> np.ndarray:
    """x * log2(x), 0 for 0."""
    return counts * np.log2(np.where(counts > 0, counts, 1))


class StateTable:
    """Rows of states as 0/1 columns for each state, so that one product counts a row's states against those of all others."""

    def __init__(self, states: np.ndarray) -> None:
        self.n = states.shape[1]
        values = np.unique(states)
        self.hot = np.stack([states == v for v in values], 1).astype(np.float32)  # row, state, sample
        self.own = _bits(self.hot.sum(axis=2).astype(float)).sum(axis=1)

    def uncertainty(self, row: int, others: np.ndarray) -> np.ndarray:
        """Symmetric uncertainty of a row and each of the others; 0 where both are constant."""
        joint = _bits((self.hot[others] @ self.hot[row].T).astype(float)).sum(axis=(1, 2))
        whole = self.n * np.log2(self.n)
        apart = 2 * whole - self.own[others] - self.own[row]  # n times both entropies
        shared = whole - self.own[others] - self.own[row] + joint
        return np.divide(2 * shared, apart, out=np.zeros(len(joint)), where=apart > 1e-9)

    def alike(self, rows: np.ndarray, others: np.ndarray, distance: int, most_su: float) -> np.ndarray:
        """Of every row and other, whether they are within `distance` or their symmetric uncertainty is above `most_su`."""
        k = self.hot.shape[1]
        joint = self.hot[others].reshape(-1, self.n) @ self.hot[rows].reshape(-1, self.n).T
        joint = joint.astype(np.int32).reshape(len(others), k, len(rows), k).transpose(2, 0, 1, 3)  # row, other, state of the other, state of the row
        equal = np.einsum("ijaa->ij", joint)
        whole = self.n * np.log2(self.n)
        apart = 2 * whole - self.own[others] - self.own[rows][:, None]  # in the order of uncertainty(), so that both round alike
        shared = whole - self.own[others] - self.own[rows][:, None] + _bits(np.arange(self.n + 1.0))[np.ascontiguousarray(joint)].sum(axis=(2, 3))
        return (self.n - equal <= distance) | (np.divide(2 * shared, apart, out=np.zeros(apart.shape), where=apart > 1e-9) > most_su)


def greedy_keep(states: np.ndarray, distance: int, most_su: float = 0.7) -> np.ndarray:
    """Rows kept: in order, those neither within `distance` of a kept row nor above `most_su` with one.

    Rows are judged by blocks: one product against blocks of kept rows, which those it rules out leave, then one among themselves.
    Of equal rows only the first is judged: what it, or the kept row that rules it out, is to it, it is to the others.
    """
    rows = np.sort(np.unique(states, axis=0, return_index=True)[1]) if distance >= 0 else np.arange(len(states))
    table, kept = StateTable(states[rows]), np.zeros(0, int)
    for start in range(0, len(rows), BLOCK):
        left = np.arange(start, min(start + BLOCK, len(rows)))
        for k in range(0, len(kept), BLOCK):
            left = left[~table.alike(left, kept[k : k + BLOCK], distance, most_su).any(axis=1)]
        near, own = table.alike(left, left, distance, most_su), []
        for i in range(len(left)):
            if not near[i, own].any():
                own.append(i)
        kept = np.append(kept, left[own])
    return rows[kept]


def reduced(states: np.ndarray, most_su: float = 0.5) -> np.ndarray:
    """Rows left when of every two with a symmetric uncertainty above `most_su` the earlier one goes."""
    table, rows = StateTable(states), np.arange(len(states))
    return np.array([i for i in rows if not (table.uncertainty(i, rows[i + 1 :]) > most_su).any()], int)


def reduce_features(matrix: DataFrame, most_su: float = 0.5) -> DataFrame:
    """(bucket, kmer_id, states) -> the rows that no later row of their bucket, by kmer_id, says nearly the same as."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("kmer_id", ignore_index=True)
        return frame.iloc[reduced(np.stack(frame["states"].to_numpy()), most_su)]

    return matrix.select("bucket", "kmer_id", "states").groupBy("bucket").applyInPandas(run, "bucket string, kmer_id bigint, states array<int>")


def drop_redundant(matrix: DataFrame, distance: int, most_su: float = 0.7) -> DataFrame:
    """(bucket, kmer_id, states) -> the rows kept; buckets are independent and go to tasks of their own, without rows whose states an earlier one has."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("kmer_id", ignore_index=True)
        return frame.iloc[greedy_keep(np.stack(frame["states"].to_numpy()), distance, most_su)]

    rows = matrix.select("bucket", "kmer_id", "states")
    if distance >= 0:  # a row equal to an earlier one never stays
        rows = rows.groupBy("bucket", "states").agg(F.min("kmer_id").alias("kmer_id")).select("bucket", "kmer_id", "states")
    return rows.groupBy("bucket").applyInPandas(run, "bucket string, kmer_id bigint, states array<int>")
