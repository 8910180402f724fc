"""Cross-validation and permutation test of a feature set, as rows of one Spark job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import linear_scores, unit_rows


def stratified_folds(groups: np.ndarray, folds: int, rng: np.random.Generator) -> np.ndarray:
    """Fold of each sample; every group is dealt evenly."""
    fold = np.zeros(len(groups), int)
    for g in np.unique(groups):
        at = rng.permutation(np.flatnonzero(groups == g))
        fold[at] = np.arange(len(at)) % folds
    return fold


def cross_validate(spark: SparkSession, x: np.ndarray, groups: list[str], folds: int = 5, permutations: int = 0, seed: int = 0) -> DataFrame:
    """(permutation, fold, train, test) accuracies; permutation 0 has the true groups, the others shuffled ones.

    `x` is samples by chosen features, which the driver holds anyway; each task takes some permutations.
    Folds need at least two groups on their training side.
    """
    y, rows = np.unique(groups, return_inverse=True)[1], unit_rows(np.asarray(x, float))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p in frame["permutation"]:
                rng = np.random.default_rng([seed, p])
                labels = rng.permutation(y) if p else y
                fold = stratified_folds(labels, folds, rng)
                for f in range(folds):
                    train, test = fold != f, fold == f
                    if test.any() and len(np.unique(labels[train])) > 1:
                        scores = (linear_scores(rows[train], labels[train], rows[part], labels[part]) for part in (train, test))
                        out.append((p, f, *scores))
            yield pd.DataFrame(out, columns=["permutation", "fold", "train", "test"])

    ids = spark.range(permutations + 1).withColumnRenamed("id", "permutation").repartition(min(permutations + 1, spark.sparkContext.defaultParallelism))
    return ids.mapInPandas(run, "permutation bigint, fold int, train double, test double")


def summary(validated: DataFrame) -> DataFrame:
    """Means and deviations of the true groups' folds, and p: (1 + shuffles at least as good) / (1 + shuffles)."""
    means = validated.groupBy("permutation").agg(*(f(c).alias(f"{c}_{n}") for c in ("train", "test") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    true = means.where("permutation = 0").drop("permutation")
    shuffled = means.where("permutation > 0").select(F.col("test_mean").alias("s"))
    one = true.join(shuffled, F.lit(True), "left")  # one row on the left
    return one.groupBy(*true.columns).agg(((1 + F.count(F.when(F.col("s") >= F.col("test_mean"), 1))) / (1 + F.count("s"))).alias("p"))
