"""Evaluation of feature sets: neighbours, confusion, precision and recall, cluster quality, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_distances(matrix: DataFrame, samples: DataFrame) -> DataFrame:
    """(ord1, ord2, distance), both orders: Euclidean distances of samples over a long matrix.

    Features are joined with themselves, so zeros cost nothing; the result has a row for each two samples.
    """
    a, b = matrix.select("kmer_id", F.col("ord").alias("ord1"), F.col("val").alias("v1")), matrix.select("kmer_id", F.col("ord").alias("ord2"), F.col("val").alias("v2"))
    dots = a.join(b, "kmer_id").groupBy("ord1", "ord2").agg(F.sum(F.col("v1") * F.col("v2")).alias("dot"))
    norms = matrix.groupBy("ord").agg(F.sum(F.col("val") * F.col("val")).alias("q"))
    every = samples.select(F.col("ord").alias("ord1")).join(samples.select(F.col("ord").alias("ord2")), F.col("ord1") != F.col("ord2"))
    joined = every.join(dots, ["ord1", "ord2"], "left").join(norms.select(F.col("ord").alias("ord1"), F.col("q").alias("q1")), "ord1", "left").join(norms.select(F.col("ord").alias("ord2"), F.col("q").alias("q2")), "ord2", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.select("ord1", "ord2", F.sqrt(F.greatest(F.lit(0.0), zero("q1") + zero("q2") - 2 * zero("dot"))).alias("distance"))


def nearest_vote(distances: DataFrame, samples: DataFrame, k: int = 5) -> DataFrame:
    """(ord, grp, predicted): the group of most of a sample's `k` nearest others; ties go to the lesser group."""
    near = distances.withColumn("r", F.row_number().over(Window.partitionBy("ord1").orderBy(F.round("distance", 6), "ord2"))).where(F.col("r") <= k)
    votes = near.join(samples.select(F.col("ord").alias("ord2"), F.col("grp").alias("vote")), "ord2").groupBy("ord1", "vote").agg(F.count("*").alias("n"))
    won = votes.groupBy(F.col("ord1").alias("ord")).agg(F.min_by("vote", F.struct(-F.col("n"), F.col("vote"))).alias("predicted"))
    return samples.select("ord", "grp").join(won, "ord")


def confusion(predictions: DataFrame) -> DataFrame:
    """(grp, predicted, percent of the group)."""
    counts = predictions.groupBy("grp", "predicted").agg(F.count("*").alias("n"))
    return counts.select("grp", "predicted", (100 * F.col("n") / F.sum("n").over(Window.partitionBy("grp"))).alias("percent"))


def precision_recall(scored: DataFrame) -> DataFrame:
    """(cls, score, label) -> a point for each distinct score, highest first: precision and recall of all at or above it.

    Scores are counted before they are cumulated, so a class's window holds its distinct scores only.
    """
    counts = scored.groupBy("cls", "score").agg(F.sum("label").alias("hits"), F.count("*").alias("n"))
    above, whole = Window.partitionBy("cls").orderBy(F.desc("score")), Window.partitionBy("cls")
    return counts.select("cls", "score", (F.sum("hits").over(above) / F.sum("n").over(above)).alias("precision"), F.try_divide(F.sum("hits").over(above), F.sum("hits").over(whole)).alias("recall"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over the curve's points of precision times what recall rises."""
    rise = F.col("recall") - F.coalesce(F.lag("recall").over(Window.partitionBy("cls").orderBy(F.desc("score"))), F.lit(0.0))
    return precision_recall(scored).withColumn("rise", rise).groupBy("cls").agg(F.sum(F.col("precision") * F.col("rise")).alias("average_precision"))


def silhouette(distances: DataFrame, samples: DataFrame) -> DataFrame:
    """(ord, silhouette) from distances of samples; 0 for a sample that is alone in its group."""
    sums = distances.join(samples.select(F.col("ord").alias("ord1"), F.col("grp").alias("g1")), "ord1").join(samples.select(F.col("ord").alias("ord2"), F.col("grp").alias("g2")), "ord2").groupBy("ord1", "g1", "g2").agg(F.avg("distance").alias("d"))
    ab = sums.groupBy(F.col("ord1").alias("ord")).agg(F.max(F.when(F.col("g1") == F.col("g2"), F.col("d"))).alias("a"), F.min(F.when(F.col("g1") != F.col("g2"), F.col("d"))).alias("b"))
    return ab.select("ord", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """(vals, grp) -> one row: spread between groups over spread within them, each by its degrees of freedom."""
    cells = points.select("grp", F.posexplode("vals").alias("axis", "x")).withColumn("x", F.col("x").cast("double"))
    sums = cells.groupBy("grp", "axis").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    axes = sums.groupBy("axis").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("k"))
    within, between = F.sum(F.col("q") - F.col("b")), F.sum(F.col("b") - F.col("s") * F.col("s") / F.col("n"))
    return axes.agg(F.try_divide(between / (F.max("k") - 1), within / (F.max("n") - F.max("k"))).alias("calinski_harabasz"))


def components(points: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Principal components of (vals): rows with a vector `components`, and the share of variance of each."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    features = points.withColumn("_v", array_to_vector(F.transform("vals", lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="components").fit(features)
    return model.transform(features).drop("_v"), model.explainedVariance.toArray().tolist()
