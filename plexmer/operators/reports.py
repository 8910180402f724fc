"""Report tables of search runs: filters of individuals, when the best list settled, correlations, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import heads


def unique_rank(scores: DataFrame) -> DataFrame:
    """(run, ind, score) -> rank from the best without ties: equal scores by ind."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("score"), "ind")))


def good_individuals(individuals: DataFrame, least_test: float, least_outer: float = float("-inf")) -> DataFrame:
    """Individuals whose test and outer scores reach both floors; without an outer score none does unless its floor is minus infinity."""
    outer = F.lit(True) if least_outer == float("-inf") else F.col("outer") >= least_outer
    return individuals.where((F.col("score") >= least_test) & outer)


def imported_individuals(individuals: DataFrame, least_views: int, least_score: float) -> DataFrame:
    """(run, kmers, nview, score) of sets that occur at least so often, or are the best of an iteration of their run, and reach the score."""
    best = F.row_number().over(Window.partitionBy("run", "iter").orderBy(F.desc("score"), F.array_join(F.transform("kmers", lambda k: k.cast("string")), ","))) == 1
    sets = individuals.withColumn("best", best).groupBy("run", "kmers").agg(F.count("*").alias("nview"), F.max("score").alias("score"), F.max("best").alias("best"))
    return sets.where(((F.col("nview") >= least_views) | F.col("best")) & (F.col("score") >= least_score)).drop("best")


def latest(individuals: DataFrame) -> DataFrame:
    """(run, iter): each run's last iteration."""
    return individuals.groupBy("run").agg(F.max("iter").alias("iter"))


def mean_scores(occ: DataFrame) -> DataFrame:
    """(kmer_id, nview, mean_score) of (kmer_id, nview, score_cum), over all runs."""
    return occ.groupBy("kmer_id").agg(F.sum("nview").alias("nview"), F.try_divide(F.sum("score_cum"), F.sum("nview")).alias("mean_score"))


def settled(individuals: DataFrame, step: int, top: int = 5, least: int = 3) -> DataFrame:
    """(run, bound): the first multiple of `step` iterations by which `least` of the run's final `top` k-mers, by views, are in its running `top`.

    Head lists change only in bins that view a k-mer, so `heads.running_heads` has a row only for these.  Ties go to the smaller k-mer.
    Runs that never get there have no row.
    """
    found = heads.running_heads(heads.views(individuals, step, "run"), top)
    final = heads.final(found)  # at most `top` rows a run
    enough = found.where(F.col("bin") < heads.LATE).join(final, ["run", "kmer_id"]).groupBy("run", "bin").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return enough.groupBy("run").agg((F.min("bin") * step).alias("bound"))


def neighbour_cut(counts: DataFrame) -> int | None:
    """First i >= 1 at which the values after and before are equal in (i, n), i from 0; None for ten values or fewer, or where there is none."""
    if counts.count() <= 10:
        return None
    order = Window.orderBy("i")  # a row for each number of views
    beside = counts.select("i", (F.lead("n").over(order) == F.lag("n").over(order)).alias("level"))
    return beside.where("level").agg(F.min("i")).first()[0]


def correlation_table(runs: DataFrame, settings: list[str], outcomes: list[str]) -> DataFrame:
    """(setting, outcome, corr): Pearson correlation of every setting with every outcome over a table of runs; one pass."""
    pairs = [(s, o) for s in settings for o in outcomes]
    found = runs.agg(*(F.corr(F.col(s).cast("double"), F.col(o).cast("double")).alias(f"c{i}") for i, (s, o) in enumerate(pairs)))
    return found.select(F.inline(F.array(*(F.struct(F.lit(s).alias("setting"), F.lit(o).alias("outcome"), F.col(f"c{i}").alias("corr")) for i, (s, o) in enumerate(pairs)))))


def quarter_correlations(rows: DataFrame, by: str, order: str, x: str, y: str) -> DataFrame:
    """(by, whole, first, last): correlation over all rows of a group, its first quarter without the first row, and its last without the last row."""
    n = F.count("*").over(Window.partitionBy(by))
    placed = rows.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).withColumn("_n", n).withColumn("_q", F.floor(F.col("_n") / 4))
    part = lambda on: F.corr(F.when(on, F.col(x)), F.when(on, F.col(y)))
    first, last = (F.col("_i") >= 1) & (F.col("_i") < F.col("_q")), (F.col("_i") >= F.col("_n") - F.col("_q")) & (F.col("_i") < F.col("_n") - 1)
    return placed.groupBy(by).agg(F.corr(x, y).alias("whole"), part(first).alias("first"), part(last).alias("last"))


def top_with_runs(merged: DataFrame, occ: DataFrame, top: int = 40) -> DataFrame:
    """(kmer_id, view, run, nview): the best merged k-mers with their views in each run."""
    best = merged.orderBy(F.desc(F.round("view", 9)), "kmer_id").limit(top).select("kmer_id", "view")  # at most `top` rows
    return occ.join(F.broadcast(best), "kmer_id").select("kmer_id", "view", "run", "nview")


def run_correlations(merged: DataFrame, occ: DataFrame) -> DataFrame:
    """(run, corr): how a run's views go with the number of runs that have a k-mer."""
    return occ.join(merged.select("kmer_id", "viewinfold"), "kmer_id").groupBy("run").agg(F.corr("viewinfold", "nview").alias("corr"))


def binary_entropy(values: Column, threshold: float) -> Column:
    """Entropy in bits of an array cut at a threshold; 0 of an empty one."""
    n = F.size(values)
    p = F.try_divide(F.size(F.filter(values, lambda v: v > threshold)).cast("double"), n)
    part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(0.0)
    return part(F.coalesce(p, F.lit(0.0))) + part(F.coalesce(1 - p, F.lit(0.0)))


def thinned(curve: DataFrame, by: str, order: str, most: int = 500) -> DataFrame:
    """About `most` evenly spaced rows of each group's curve, from its first."""
    n = F.count("*").over(Window.partitionBy(by))
    step = F.greatest(F.lit(1), F.ceil(n / most))
    return curve.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).withColumn("_s", step).where("_i % _s = 0").drop("_i", "_s")


def without_samples(dense: DataFrame, samples: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The matrix and its samples without those of these names; the rest is numbered anew."""
    kept = [r for r in samples.orderBy("ord").collect() if r["name"] not in set(names)]  # a row a sample
    rows = dense.select("kmer_id", F.array(*(F.get("vals", F.lit(r["ord"])) for r in kept)).alias("vals"))
    return rows, samples.sparkSession.createDataFrame([(i, r["name"], str(r["grp"])) for i, r in enumerate(kept)], "ord int, name string, grp string")


def filled_log(entries: DataFrame, generations: DataFrame, features: list[str]) -> DataFrame:
    """(run, gen, feature, value) -> a row a generation with a column a feature; what was never set is NA, and the last value set for one holds."""
    wide = entries.groupBy("run", "gen").pivot("feature", features).agg(F.last("value"))
    return generations.select("run", "gen").join(wide, ["run", "gen"], "left").select("run", "gen", *(F.coalesce(F.col(f), F.lit("NA")).alias(f) for f in features))
