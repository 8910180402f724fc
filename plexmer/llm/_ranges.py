"""Sampled splitters: range buckets as plain column expressions.

`repartitionByRange` samples anew on every run; explicit splitters make the
bucket a column, so later steps can refer to it and reruns agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def id_splitters(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Values of the bigint column `key` that cut it into about equal ranges, ascending, distinct.

    At most `buckets` - 1 numbers reach the driver.
    """
    shares = [i / buckets for i in range(1, buckets)]
    got = df.agg(F.percentile_approx(key, shares, 10_000) if shares else F.lit(None)).first()[0]
    return sorted(set(got or []))


def not_above(key: Column, cuts: list[Column]) -> Column:
    """How many of the ascending literals `cuts` are not above the key, by binary search: one comparison for each power of two."""
    if not cuts:
        return F.lit(0)
    table, n = F.array(*cuts), len(cuts)
    steps = F.array(*(F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)))
    # transform() over one element names the key, so that it is computed once
    return F.element_at(
        F.transform(F.array(key), lambda k: F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) <= k), at + step).otherwise(at))), 1
    )


def bucket_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters that are not above the bigint key; null is -1."""
    return F.when(key.isNull(), F.lit(-1)).otherwise(not_above(key, [F.lit(s).cast("bigint") for s in splitters]))


def wanted_buckets(spark: SparkSession) -> int:
    """Buckets for one shuffle: two for each shuffle partition, so that hashing bucket numbers evens out."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
