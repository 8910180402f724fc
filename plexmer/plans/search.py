"""Genetic search for small discriminating feature sets.

The population is small and lives on the driver under one seeded generator; each
generation fetches the rows of its genes once and scores all individuals in one
Spark job.  Fitness is held-out accuracy of a one-vs-rest linear classifier
(squared hinge, balanced classes) on L2-normalised features.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Config:
    individuals: int = 200
    generations: int = 10
    kmers: int = 5
    elite: int = 1
    kill_ratio: float = 0.5
    algorithm: str = "GA"
    #: Rates below, at and above the mean score; GA and AGA use the first.
    mutation: tuple[float, float, float] = (0.25, 0.05, 0.0)
    translocation: tuple[float, float, float] = (0.8, 0.5, 0.1)
    #: (highest, lowest, lambda) of the logistic schedule, for mutation and translocation.
    logistic_mutation: tuple[float, float, float] = (0.25, 0.05, 1.0)
    logistic_translocation: tuple[float, float, float] = (0.8, 0.5, 1.0)
    #: Draws of a mate's tournament; 0 takes any individual.
    tournament: int = 0
    one_gene_mutation: bool = False
    #: Every so many generations the elite but its best is redrawn; 0 never.
    kill_elite_every: int = 0
    outer_rate: float = 0.17
    test_rate: float = 0.3
    rotations: int = 2
    stop_score: float = 1.1
    #: Standard deviations of normal noise added to each feature of the training samples, and of the test samples.
    train_noise: float = 0.0
    test_noise: float = 0.0
    seed: int = 0


def outer_holdout(groups: np.ndarray, rate: float, rng: np.random.Generator) -> np.ndarray:
    """-1 for floor(rate * smallest group) random samples of every group, else 0."""
    names, counts = np.unique(groups, return_counts=True)
    state = np.zeros(len(groups), int)
    for g in names:
        state[rng.permutation(np.flatnonzero(groups == g))[: int(rate * counts.min() + 1e-9)]] = -1
    return state


def rotate(groups: np.ndarray, outer: np.ndarray, rate: float, rotations: int, rng: np.random.Generator) -> np.ndarray:
    """Bit r of a sample is set if it is a test sample of rotation r; outer samples stay -1."""
    inner = np.flatnonzero(outer == 0)
    smallest = min(np.sum(groups[inner] == g) for g in np.unique(groups))
    state = outer.copy()
    for r in range(rotations):
        for g in np.unique(groups):
            state[rng.permutation(inner[groups[inner] == g])[: max(1, int(rate * smallest + 1e-6))]] += 1 << r
    return state


def linear_scores(x: np.ndarray, y: np.ndarray, test: np.ndarray, truth: np.ndarray, steps: int = 60) -> float:
    """Accuracy on `test` of one-vs-rest squared-hinge classifiers fitted by Newton-type steps on (x, y)."""
    classes = np.unique(y)
    design, probe = np.c_[x, np.ones(len(x))], np.c_[test, np.ones(len(test))]
    margins = []
    for c in classes:
        t = np.where(y == c, 1.0, -1.0)
        weight = len(y) / (2 * np.where(y == c, (y == c).sum(), max(1, (y != c).sum())))
        w = np.zeros(design.shape[1])
        for _ in range(steps):
            slack = 1 - t * (design @ w)
            on = slack > 0
            a = design[on] * weight[on, None]
            step = np.linalg.solve(np.eye(len(w)) + 2 * a.T @ design[on], w - 2 * a.T @ (t[on] * slack[on]))
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        margins.append(probe @ w)
    return float((classes[np.argmax(margins, axis=0)] == truth).mean())


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def noisy(x: np.ndarray, factor: float, rng: np.random.Generator) -> np.ndarray:
    """Each column with normal noise of `factor` times its standard deviation (of the population)."""
    return x + rng.standard_normal(x.shape) * x.std(axis=0) * factor if factor else x


def fitness(spark: SparkSession, population: list[tuple[int, ...]], block: dict[int, np.ndarray], groups: np.ndarray, state: np.ndarray, config: Config, seed: int = 0) -> np.ndarray:
    """Mean accuracy of every individual over rotations, one task a slice of the population; the genes' rows, a generation's, are broadcast."""
    shared = spark.sparkContext.broadcast(block)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for genes in frame["genes"]:
                x = unit_rows(np.stack([shared.value[g] for g in genes], 1))
                parts, rng = [], np.random.default_rng([seed, *(int(g) % 2**32 for g in genes)])
                for r in range(config.rotations):
                    test = (state > 0) & ((state >> r) & 1 == 1)
                    train = (state >= 0) & ~test
                    parts.append(linear_scores(noisy(x[train], config.train_noise, rng), groups[train], noisy(x[test], config.test_noise, rng), groups[test]))
                out.append(float(np.mean(parts)))
            yield pd.DataFrame({"ind": frame["ind"], "score": out})

    rows = spark.createDataFrame([(i, [int(g) for g in p]) for i, p in enumerate(population)], "ind int, genes array<bigint>")
    got = rows.repartition(min(len(population), spark.sparkContext.defaultParallelism)).mapInPandas(score, "ind int, score double").collect()
    shared.destroy()
    return np.array([r["score"] for r in sorted(got)])


def kill_probabilities(scores: np.ndarray) -> np.ndarray:
    """Selection probabilities that sum to 1, from the worst shift gamma = min - 2 median."""
    shifted = scores + scores.min() - 2 * np.median(scores)
    total = shifted.sum()
    return shifted / total if total else np.full(len(scores), 1 / len(scores))


def rank(scores: np.ndarray) -> np.ndarray:
    """1 for the best; equal scores share the worse rank."""
    return len(scores) - np.searchsorted(np.sort(scores), scores, "left")


def rate(algorithm: str, score: float, scores: np.ndarray, rates: tuple[float, float, float], logistic: tuple[float, float, float]) -> float:
    """Probability that an individual of this score is changed.

    GA: constant.  AGA: falls in a line from the mean score to 0 at the best one.  IAGA: falls from the first rate at the
    worst over the second at the mean to the third at the best.  IAGA_Ravindran: logistic above the mean.
    Where all scores on a side are equal, the rate at the mean holds.
    """
    low, mean, high = float(scores.min()), float(scores.mean()), float(scores.max())
    share = lambda x, span: x / span if span > 0 else 0.0
    if algorithm == "GA":
        return rates[0]
    if algorithm == "AGA":
        return rates[0] if score < mean else rates[0] * (1 - share(score - mean, high - mean))
    if algorithm == "IAGA":
        if score < mean:
            t = share(score - low, mean - low)
            return rates[0] + t * (rates[1] - rates[0])
        return rates[1] + share(score - mean, high - mean) * (rates[2] - rates[1])
    if algorithm == "IAGA_Ravindran":
        most, least, slope = logistic
        return most if score < mean else least / (1 + math.exp(slope * share(score - mean, high - mean)))
    raise ValueError(f"no such algorithm: {algorithm}")


def mate(scores: np.ndarray, draws: int, rng: np.random.Generator) -> int:
    """Best of `draws` random individuals; with 0 any one."""
    drawn = rng.integers(len(scores), size=max(1, draws))
    return int(drawn[np.argmax(scores[drawn])])


def grid(**choices: list) -> list[Config]:
    """One Config for each combination of the listed values."""
    return [replace(Config(), **dict(zip(choices, values))) for values in itertools.product(*choices.values())]


class Pool:
    """Random features, drawn some thousands at a time: those lowest by a hash of id and draw, so ids stay in the cluster."""

    def __init__(self, matrix: DataFrame, size: int, seed: int, draws: int = 0) -> None:
        self.matrix, self.size, self.seed, self.draws, self.waiting = matrix, size, seed, draws, []

    def take(self) -> int:
        if not self.waiting:
            found = self.matrix.select("kmer_id").orderBy(F.xxhash64("kmer_id", F.lit(self.seed), F.lit(self.draws)), "kmer_id").limit(self.size).collect()
            self.waiting, self.draws = [int(r["kmer_id"]) for r in found][::-1], self.draws + 1
            if not self.waiting:
                raise ValueError("no features to search")
        return self.waiting.pop()


def key(genes: list[int] | tuple[int, ...]) -> tuple[int, ...]:
    return tuple(sorted(genes))


def fresh(pool: Pool, kmers: int, known: set[tuple[int, ...]], tries: int = 1000) -> tuple[int, ...]:
    """A random individual of distinct features that is not known yet, if `tries` draws give one."""
    for _ in range(tries):
        genes: list[int] = []
        for _ in range(100 * kmers):
            if len(genes) == kmers:
                break
            if (g := pool.take()) not in genes:
                genes.append(g)
        if len(genes) < kmers:
            raise ValueError(f"fewer than {kmers} features to search")
        if key(genes) not in known:
            break
    return tuple(genes)


def mutated(genes: tuple[int, ...], gene_rate: float, one: bool, pool: Pool, known: set[tuple[int, ...]], rng: np.random.Generator, tries: int = 1000) -> tuple[int, ...]:
    """Each gene redrawn with probability `gene_rate`, or `one` alone; genes go on being redrawn until the individual is new and its genes differ."""
    new = list(genes)
    hit = np.arange(len(new)) == rng.integers(len(new)) if one else rng.random(len(new)) < gene_rate
    for i in np.flatnonzero(hit):
        new[i] = pool.take()
    for _ in range(tries):
        if key(new) not in known and len(set(new)) == len(new):
            return tuple(new)
        new[rng.integers(len(new))] = pool.take()
    return genes


def translocated(genes: tuple[int, ...], other: tuple[int, ...], pool: Pool, known: set[tuple[int, ...]], rng: np.random.Generator) -> tuple[int, ...]:
    """A stretch of `other` in place of one of `genes`; what then comes twice is redrawn.  The old individual where the new one is known."""
    size = int(rng.integers(len(genes)))
    a, b = rng.integers(len(genes) - size + 1, size=2)
    new = [*genes[:a], *other[b : b + size], *genes[a + size :]]
    for i in range(len(new)):
        for _ in range(100):
            if new[i] not in new[:i]:
                break
            new[i] = pool.take()
    return tuple(new) if len(set(new)) == len(new) and key(new) not in known else genes


def save_state(spark: SparkSession, folder: str, generation: int, state: dict) -> None:
    """One small text file a generation."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/generation={generation:08d}")


def last_state(spark: SparkSession, folder: str) -> dict | None:
    """The newest whole state of a folder, None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    done = sorted(str(f.getPath()) for f in system.listStatus(path) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))
    return json.loads(spark.read.text(done[-1]).first()["value"]) if done else None


def run(spark: SparkSession, matrix: DataFrame, groups: list[str], config: Config, population: list[tuple[int, ...]] | None = None, outer: np.ndarray | None = None, keep: list[int] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Search (kmer_id, vals); a row a generation: best score, outer score, mean of the ten best, best individual.

    `population` and `outer` restart a search, `keep` restricts it to the listed k-mers.  With `checkpoint`, a folder that all
    machines share, every generation is written there, and a search that finds one goes on after it, to the same history.
    """
    rng, y = np.random.default_rng(config.seed), np.unique(groups, return_inverse=True)[1]
    if keep is not None:
        matrix = matrix.join(F.broadcast(spark.createDataFrame([(int(k),) for k in keep], "kmer_id bigint").distinct()), "kmer_id", "left_semi")  # a list the caller holds
    matrix = matrix.persist()
    pool = Pool(matrix, 4 * config.individuals * config.kmers, config.seed)
    saved = last_state(spark, checkpoint) if checkpoint else None
    history, start = [], 0
    if saved:
        history, start, outer = [tuple(h) for h in saved["history"]], saved["generation"] + 1, np.array(saved["outer"])
        population, rng.bit_generator.state = [tuple(p) for p in saved["population"]], saved["random"]
        pool.draws, pool.waiting = saved["draws"], saved["waiting"]
    else:
        population = [tuple(p) for p in population or ()][: config.individuals]
        known = set(map(key, population))
        while len(population) < config.individuals:
            population.append(fresh(pool, config.kmers, known))
            known.add(key(population[-1]))
        outer = outer_holdout(y, config.outer_rate, rng) if outer is None else np.asarray(outer)
    block: dict[int, np.ndarray] = {}
    for generation in range(start, config.generations):
        if history and history[-1][1] >= config.stop_score:
            break
        # rows of this generation's genes: individuals x kmers at most
        genes = {g for p in population for g in p}
        block = {g: v for g, v in block.items() if g in genes}
        listed = F.broadcast(spark.createDataFrame([(int(g),) for g in sorted(genes - set(block))], "kmer_id bigint"))
        block |= {r["kmer_id"]: np.array(r["vals"]) for r in matrix.join(listed, "kmer_id").collect()}
        state = rotate(y, outer, config.test_rate, config.rotations, rng)
        scores = fitness(spark, population, block, y, state, config, config.seed + generation)
        ranks, best = rank(scores), int(np.argmax(scores))
        x = unit_rows(np.stack([block[g] for g in population[best]], 1))
        held = outer == -1
        outer_score = linear_scores(x[~held], y[~held], x[held], y[held]) if held.any() else float("nan")
        history.append((generation, float(scores[best]), outer_score, float(np.sort(scores)[::-1][:10].mean()), sorted(int(g) for g in population[best])))
        population = _bred(population, scores, ranks, best, generation, config, pool, rng)
        if checkpoint:
            state = {"generation": generation, "history": history, "population": population, "outer": outer.tolist(), "random": rng.bit_generator.state, "draws": pool.draws, "waiting": pool.waiting}
            save_state(spark, checkpoint, generation, state)
    matrix.unpersist()
    return spark.createDataFrame(history, "generation int, best double, outer_score double, top10 double, kmers array<bigint>")


def _bred(population: list[tuple[int, ...]], scores: np.ndarray, ranks: np.ndarray, best: int, generation: int, config: Config, pool: Pool, rng: np.random.Generator) -> list[tuple[int, ...]]:
    """The next generation: killed ones drawn anew, then mutation or translocation, and now and then a new elite."""
    population, p = list(population), kill_probabilities(scores)
    known = set(map(key, population))

    def put(i: int, genes: tuple[int, ...]) -> None:
        population[i] = tuple(int(g) for g in genes)
        known.add(key(population[i]))

    for i in range(len(population)):
        if ranks[i] > config.elite and rng.random() <= p[ranks <= ranks[i]].sum() * 2 * config.kill_ratio:
            put(i, fresh(pool, config.kmers, known))
    for i in range(len(population)):
        if ranks[i] <= config.elite:
            continue
        if rng.random() < (chance := rate(config.algorithm, scores[i], scores, config.mutation, config.logistic_mutation)):
            put(i, mutated(population[i], chance, config.one_gene_mutation, pool, known, rng))
        elif rng.random() < rate(config.algorithm, scores[i], scores, config.translocation, config.logistic_translocation):
            put(i, translocated(population[i], population[mate(scores, config.tournament, rng)], pool, known, rng))
    if config.kill_elite_every and (generation + 1) % config.kill_elite_every == 0:
        for i in np.flatnonzero(ranks < config.elite):
            if i != best:
                put(i, fresh(pool, config.kmers, known))
    return population
