"""Comparison of classifiers on a feature set: folds, random rotations and what becomes of each sample, as rows of one Spark job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classifiers import KINDS, fit, predict
from .search import unit_rows
from .validation import stratified_folds

ROWS = "kind string, part int, sample int, truth string, guess string, train_accuracy double, test_accuracy double"


def rotations(groups: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """True for about `share` random samples of each group, one at least."""
    test = np.zeros(len(groups), bool)
    for g in np.unique(groups):
        at = rng.permutation(np.flatnonzero(groups == g))
        test[at[: max(1, round(share * len(at)))]] = True
    return test


def predictions(spark: SparkSession, x: np.ndarray, groups: list[str], kinds: tuple[str, ...] = KINDS, folds: int = 5, turns: int = 0, share: float = 0.3, without: list[int] | None = None, seed: int = 0) -> DataFrame:
    """(ROWS): each test sample's guess by each kind, in every fold, or in `turns` random rotations if these are asked for.

    `x` is samples by chosen features, which the driver holds anyway; samples listed in `without` are left out.
    A part whose training side has one group only gives no rows.
    """
    rows, names = unit_rows(np.asarray(x, float)), np.asarray(groups)
    use = np.setdiff1d(np.arange(len(names)), without or [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kind, part in zip(frame["kind"], frame["part"], strict=True):
                rng = np.random.default_rng([seed, part if turns else 0])
                y = names[use]
                test = rotations(y, share, rng) if turns else stratified_folds(y, folds, rng) == part
                if not test.any() or len(np.unique(y[~test])) < 2:
                    continue
                model = fit(kind, rows[use][~test], y[~test], seed)
                guess, own = predict(model, rows[use][test]), predict(model, rows[use][~test])
                right = float((guess == y[test]).mean())
                out += [(kind, part, int(s), t, g, float((own == y[~test]).mean()), right) for s, t, g in zip(use[test], y[test], guess, strict=True)]
            yield pd.DataFrame(out, columns=["kind", "part", "sample", "truth", "guess", "train_accuracy", "test_accuracy"])

    tasks = [(k, p) for k in kinds for p in range(turns or folds)]
    plan = spark.createDataFrame(tasks, "kind string, part int").repartition(min(len(tasks), 4 * spark.sparkContext.defaultParallelism))
    return plan.mapInPandas(run, ROWS)


def report(predicted: DataFrame) -> DataFrame:
    """(kind, parts, train, test, deviation): mean accuracies of each classifier and their spread over parts."""
    parts = predicted.groupBy("kind", "part").agg(F.first("train_accuracy").alias("train"), F.first("test_accuracy").alias("test"))
    return parts.groupBy("kind").agg(F.count("*").alias("parts"), F.avg("train").alias("train"), F.avg("test").alias("test"), F.stddev_pop("test").alias("deviation"))


def sample_report(predicted: DataFrame) -> DataFrame:
    """(kind, sample, truth, tested, right, false_rate, gain, guesses): how each sample fares, and by how much parts that test it score above the others."""
    parts = predicted.groupBy("kind", "part").agg(F.first("test_accuracy").alias("score"))
    whole = parts.groupBy("kind").agg(F.sum("score").alias("all_score"), F.count("*").alias("all_parts"))
    own = predicted.groupBy("kind", "sample", "truth").agg(F.count("*").alias("tested"), F.count_if(F.col("truth") == F.col("guess")).alias("right"), F.sum("test_accuracy").alias("score"), F.sort_array(F.collect_list("guess")).alias("guesses"))
    others = F.try_divide(F.col("all_score") - F.col("score"), F.col("all_parts") - F.col("tested"))
    return own.join(whole, "kind").select("kind", "sample", "truth", "tested", "right", (1 - F.col("right") / F.col("tested")).alias("false_rate"), (F.col("score") / F.col("tested") - others).alias("gain"), "guesses")


def eliminate(spark: SparkSession, x: np.ndarray, groups: list[str], kind: str = "linear", turns: int = 20, most: int = 3, seed: int = 0) -> list[int]:
    """Samples left out one after the other, each the most often wrong of its round, as long as one is wrong in most of its tests; `most` at most."""
    out: list[int] = []
    for _ in range(most):
        rows = sample_report(predictions(spark, x, groups, (kind,), turns=turns, without=out, seed=seed)).where("false_rate > 0.5")
        worst = rows.orderBy(F.desc("false_rate"), "sample").first()
        if worst is None:
            break
        out.append(worst["sample"])
    return out
