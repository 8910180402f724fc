"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_folder, workspace


def components(edges: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b: bigint).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): a
    logarithmic number of rounds, each of two aggregations with partial sums and
    two equi-joins that can be split when skewed.  Only counts reach the driver;
    every round is a table in the shared folder.
    """
    spark = edges.sparkSession
    least, most = F.least("a", "b"), F.greatest("a", "b")
    old = workspace(spark, tag)
    edges.where("a <> b").select(most.alias("u"), least.alias("v")).distinct().write.parquet(old)
    now, seen = spark.read.schema("u bigint, v bigint").parquet(old), None
    for _ in range(most_rounds):
        # large star: every neighbour above u is joined to u's least neighbour (or u)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every neighbour below u, and u itself, is joined to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        path = workspace(spark, tag)
        small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().write.parquet(path)
        now = spark.read.schema("u bigint, v bigint").parquet(path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_folder(spark, old)
        old = path
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # settled: each edge goes from a node to its component's least node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
