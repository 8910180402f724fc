"""What a search did over its iterations: head lists, convergence, similarity and order of appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import heads


def set_similarity(a: Column, b: Column) -> Column:
    """Shared members over the larger set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def mean_score(best: Column, outer: Column) -> Column:
    """Two parts of the best score and one of the outer score."""
    return (2 * best + outer) / 3


def bounded_histogram(individuals: DataFrame, last: int, top: int) -> DataFrame:
    """The `top` k-mers by views up to iteration `last`; ties by identifier."""
    seen = individuals.where(F.col("iter") <= last).select(F.explode("kmers").alias("kmer_id")).groupBy("kmer_id").agg(F.count("*").alias("nview"))
    return seen.orderBy(F.desc("nview"), "kmer_id").limit(top)


def head_distances(individuals: DataFrame, step: int, top: int) -> DataFrame:
    """(iter, distance): how many of the final `top` k-mers are not in the head list of each bound `step`, 2 `step`, ..., the last whole one included.

    Views are summed per k-mer and bin once, and `heads.running_heads` goes through the bins; the list holds in bins without views.
    """
    last = individuals.agg(F.floor(F.max("iter") / step).cast("bigint")).first()[0] or 0
    found = heads.running_heads(heads.views(individuals, step), top)
    final = heads.final(found).select("kmer_id")  # at most `top` rows
    here = F.broadcast(final.withColumn("here", F.lit(1)))
    kept = found.where(F.col("bin") <= last).join(here, "kmer_id", "left").groupBy(F.col("bin").alias("bound")).agg(F.count("here").alias("kept"))
    # a row for each bound
    held = F.coalesce(F.last("kept", True).over(Window.orderBy("bound")), F.lit(0))
    bounds = individuals.sparkSession.range(1, last + 1).withColumnRenamed("id", "bound").join(kept, "bound", "left")
    return bounds.select((F.col("bound") * step).alias("iter"), (F.lit(final.count()) - held).alias("distance"))


def converged(distances: DataFrame, slope: float = 0.01) -> bool:
    """Whether the slope around the last inner point of (iter, distance) is below `slope`; one row a bound."""
    points = distances.orderBy(F.desc("iter")).limit(3).collect()
    return len(points) == 3 and abs(points[0]["distance"] - points[2]["distance"]) / (points[0]["iter"] - points[2]["iter"]) < slope


def plateau(new_kmers: DataFrame, threshold: int) -> bool:
    """Whether any bin of `runs.first_seen` has at most `threshold` new k-mers."""
    return new_kmers.where(F.col("new_kmers") <= threshold).limit(1).count() > 0


def bin_maxima(individuals: DataFrame, step: int, floor: float) -> DataFrame:
    """Highest score, not below `floor`, of each bin of `step` iterations."""
    return individuals.where(F.col("score") >= floor).groupBy(F.floor(F.col("iter") / step).alias("bin")).agg(F.max("score").alias("score"))


def appearance(individuals: DataFrame) -> DataFrame:
    """Numbers each run's k-mers from 1 by the iteration, then the place, in which they first occur."""
    first = individuals.select("run", "iter", F.posexplode("kmers").alias("pos", "kmer_id")).groupBy("run", "kmer_id").agg(F.min(F.struct("iter", "pos")).alias("first"))
    return first.select("run", "kmer_id", F.dense_rank().over(Window.partitionBy("run").orderBy("first")).alias("appearance"))


def strided(individuals: DataFrame, step: int) -> DataFrame:
    """Every `step`-th individual of each run, counted back from its last iteration."""
    back = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("iter"))) - 1
    return individuals.withColumn("_back", back).where(F.col("_back") % step == 0).drop("_back")


def similar_individuals(individuals: DataFrame) -> DataFrame:
    """(run, iter1 < iter2, similarity) of individuals of one run that share a k-mer: an equi-join on the k-mer, not all pairs."""
    genes = individuals.select("run", "iter", F.size("kmers").alias("n"), F.explode(F.array_distinct("kmers")).alias("kmer_id"))
    other = genes.select("run", F.col("iter").alias("iter2"), F.col("n").alias("n2"), "kmer_id")
    pairs = genes.join(other, ["run", "kmer_id"]).where("iter < iter2").groupBy("run", F.col("iter").alias("iter1"), "iter2").agg(F.count("*").alias("shared"), F.max(F.greatest("n", "n2")).alias("larger"))
    return pairs.select("run", "iter1", "iter2", (F.col("shared") / F.col("larger")).alias("similarity"))


def best_individuals(individuals: DataFrame, n: int) -> DataFrame:
    """Each run's `n` best; ties by iteration."""
    return individuals.withColumn("_r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("score"), "iter"))).where(F.col("_r") <= n).drop("_r")


def kendall(occ: DataFrame, top: int) -> DataFrame:
    """(run1 < run2, shared, discordant): k-mer pairs of two runs' top lists that both have, and in how many the order differs."""
    ranked = occ.withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("nview"), "kmer_id"))).where(F.col("r") <= top).select("run", "kmer_id", "r")
    both = ranked.select(F.col("run").alias("run1"), "kmer_id", F.col("r").alias("r1")).join(ranked.select(F.col("run").alias("run2"), "kmer_id", F.col("r").alias("r2")), "kmer_id").where("run1 < run2")
    lists = both.groupBy("run1", "run2").agg(F.sort_array(F.collect_list(F.struct("r1", "r2"))).alias("l"))  # at most `top` entries
    behind = F.aggregate("l", F.lit(0), lambda s, x: s + F.size(F.filter("l", lambda y: (y["r1"] > x["r1"]) & (y["r2"] < x["r2"]))))
    return lists.select("run1", "run2", F.size("l").alias("shared"), behind.alias("discordant"))


def correlations(pairs: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Pearson correlation of two columns in each group, and the mean difference."""
    return pairs.groupBy(by).agg(F.corr(x, y).alias("corr"), F.avg(F.col(x) - F.col(y)).alias("difference"))


def list_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(size_a, both, size_b) of two lists of k-mers, without repeats."""
    a, b = a.select("kmer_id").distinct(), b.select(F.col("kmer_id").alias("k2")).distinct()
    return a.join(b, F.col("kmer_id") == F.col("k2"), "full").agg(F.count("kmer_id").alias("size_a"), F.count(F.when(F.col("kmer_id") == F.col("k2"), 1)).alias("both"), F.count("k2").alias("size_b"))


def ordered_union(*lists: DataFrame) -> DataFrame:
    """(kmer_id, pos) lists one after the other; each k-mer keeps its first list and place."""
    parts = [part.select("kmer_id", F.struct(F.lit(i).alias("list"), "pos").alias("at")) for i, part in enumerate(lists)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("kmer_id").agg(F.min("at").alias("at")).select("kmer_id", "at.list", "at.pos")
