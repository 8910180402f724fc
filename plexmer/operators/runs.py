"""Analysis of search runs: ranks, selection probabilities, occurrences, merging, overlap, networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fitness_rank(scores: DataFrame) -> DataFrame:
    """(run, ind, score) -> rank from the best; equal scores share the worse rank."""
    n = F.count("*").over(Window.partitionBy("run"))
    return scores.withColumn("rank", n + 1 - F.rank().over(Window.partitionBy("run").orderBy("score")))


def roulette(scores: DataFrame) -> DataFrame:
    """Adds p, which sums to 1 in a run, and its cumulated value up to the individual's rank, ties included."""
    stats = scores.groupBy("run").agg(F.min("score").alias("low"), F.median("score").alias("mid"), F.sum("score").alias("total"), F.count("*").alias("n"))
    gamma = F.col("low") - 2 * F.col("mid")
    p = F.try_divide(F.col("score") + gamma, F.col("total") + F.col("n") * gamma)
    ranked = fitness_rank(scores.join(stats, "run").withColumn("p", p).drop("low", "mid", "total", "n"))
    return ranked.withColumn("cumulated", F.sum("p").over(Window.partitionBy("run").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)))


def top_mean(scores: DataFrame, n: int = 10) -> DataFrame:
    best = scores.withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("score"), "ind"))).where(F.col("r") <= n)
    return best.groupBy("run").agg(F.avg("score").alias("top_mean"))


def winner(scores: DataFrame) -> DataFrame:
    return scores.groupBy("run").agg(F.min_by("ind", F.struct(-F.col("score"), F.col("ind"))).alias("ind"), F.max("score").alias("score"))


def occurrences(individuals: DataFrame, *by: str) -> DataFrame:
    """(kmers, score, ...) -> how often each k-mer is viewed and its cumulated score."""
    return individuals.select(*by, F.explode("kmers").alias("kmer_id"), "score").groupBy(*by, "kmer_id").agg(F.count("*").alias("nview"), F.sum("score").alias("score_cum"))


def mean_cut(occ: DataFrame) -> DataFrame:
    """K-mers viewed more than twice the mean."""
    mean = occ.agg(F.avg("nview")).first()[0]
    return occ.where(F.col("nview") > 2 * F.lit(mean))


def merge_runs(occ: DataFrame, top: int) -> DataFrame:
    """(run, kmer_id, nview): each run's top k-mers in per cent of them, averaged over runs, and the number of runs that have each."""
    best = occ.withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("nview"), "kmer_id"))).where(F.col("r") <= top)
    share = best.withColumn("share", 100 * F.col("nview") / F.sum("nview").over(Window.partitionBy("run")))
    n = occ.select("run").distinct().count()
    return share.groupBy("kmer_id").agg((F.sum("share") / n).alias("view"), F.count("*").alias("viewinfold"))


def merge_metrics(merged: DataFrame) -> DataFrame:
    """One row on merged runs (at most runs x top k-mers): correlation of rank and number of runs, distinct k-mers and shared ones in per cent.

    The correlation is NaN, as in SQL, where ranks or numbers of runs do not vary, and null without k-mers.
    """
    ranked = merged.withColumn("r", F.row_number().over(Window.orderBy(F.desc(F.round("view", 9)), "kmer_id")))
    corr = F.try_divide(F.covar_pop("r", "viewinfold"), F.stddev_pop("r") * F.stddev_pop("viewinfold"))
    return ranked.agg(F.when(F.count("*") > 0, F.coalesce(corr, F.lit(float("nan")))).alias("rank_corr"), F.try_divide(100.0 * F.count("*"), F.sum("viewinfold")).alias("unique_percent"), (100 * F.avg((F.col("viewinfold") > 1).cast("int"))).alias("shared_percent"))


def run_overlap(occ: DataFrame) -> DataFrame:
    """Shared k-mers of every two runs over the smaller list."""
    sizes = occ.groupBy("run").agg(F.count("*").alias("n"))
    a, b = occ.select(F.col("run").alias("run1"), "kmer_id"), occ.select(F.col("run").alias("run2"), "kmer_id")
    both = a.join(b, "kmer_id").where("run1 < run2").groupBy("run1", "run2").agg(F.count("*").alias("shared"))
    s1, s2 = sizes.select(F.col("run").alias("run1"), F.col("n").alias("n1")), sizes.select(F.col("run").alias("run2"), F.col("n").alias("n2"))
    return both.join(s1, "run1").join(s2, "run2").select("run1", "run2", "shared", (F.col("shared") / F.least("n1", "n2")).alias("ratio"))


def individual_key(kmers: Column) -> Column:
    """One text for all orders of a set: identifiers sorted as texts."""
    return F.array_join(F.array_sort(F.transform(kmers, lambda x: x.cast("string"))), ",")


def top_distinct(individuals: DataFrame, n: int) -> DataFrame:
    found = individuals.groupBy(individual_key(F.col("kmers")).alias("individual")).agg(F.max("score").alias("score"), F.count("*").alias("nbview"))
    return found.orderBy(F.desc("score"), "individual").limit(n)


def first_seen(individuals: DataFrame, step: int) -> DataFrame:
    """Number of k-mers first seen in each bin of `step` iterations."""
    first = individuals.select("iter", F.explode("kmers").alias("kmer_id")).groupBy("kmer_id").agg(F.min("iter").alias("first"))
    return first.groupBy(F.floor(F.col("first") / step).alias("bin")).agg(F.count("*").alias("new_kmers"))


def network(individuals: DataFrame) -> DataFrame:
    """Co-occurrence edges (id1 < id2): largest, mean and summed score of the individuals that hold both."""
    pairs = individuals.select("score", F.explode("kmers").alias("id1"), "kmers").select("score", "id1", F.explode("kmers").alias("id2")).where("id1 < id2")
    return pairs.groupBy("id1", "id2").agg(F.max("score").alias("w_max"), F.avg("score").alias("w_avg"), F.sum("score").alias("w_sum"))


def strength(edges: DataFrame, weight: str = "w_sum") -> DataFrame:
    both = edges.select(F.col("id1").alias("kmer_id"), weight).unionByName(edges.select(F.col("id2").alias("kmer_id"), weight))
    return both.groupBy("kmer_id").agg(F.sum(weight).alias("strength"))


def composite_score(test: Column, outer: Column, kind: str) -> Column:
    """test, outer, pro (product) or adjust (product less what test is above outer); 0 for any other kind."""
    return {"test": test, "outer": outer, "pro": test * outer, "adjust": test * outer - F.greatest(test - outer, F.lit(0.0))}.get(kind, F.lit(0.0))
