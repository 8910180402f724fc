"""Feature x sample matrices, long (implicit zeros) and dense (one array a feature)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kmers as K


def count_kmers(reads: DataFrame, k: int) -> DataFrame:
    """(sample, seq) -> (sample, kmer, cnt): canonical k-mers of each sample; partial sums are taken before the shuffle."""
    return reads.select("sample", F.explode(K.kmers(F.col("seq"), k)).alias("kmer")).withColumn("kmer", K.canonical(F.col("kmer"))).groupBy("sample", "kmer").agg(F.count("*").alias("cnt"))


def normalise(counts: DataFrame, threshold: float = 5) -> DataFrame:
    """(sample, kmer, cnt) -> (sample, kmer_id, val) per million of the sample's whole total; then counts above the threshold stay."""
    total = counts.groupBy("sample").agg(F.sum("cnt").alias("total"))
    return counts.join(total, "sample").where(F.col("cnt") > threshold).select("sample", K.encode(F.col("kmer")).alias("kmer_id"), (F.col("cnt") * 1e6 / F.col("total")).alias("val"))


def merge(*parts: DataFrame) -> DataFrame:
    """Full outer merge of matrices over disjoint samples: in the long form, a union."""
    return reduce(DataFrame.unionByName, parts)


def dense(matrix: DataFrame, n_samples: int) -> DataFrame:
    """(kmer_id, ord, val) -> (kmer_id, vals) with zeros filled in; one shuffle, no join."""
    cells = F.map_from_entries(F.collect_list(F.struct("ord", "val")))
    return matrix.groupBy("kmer_id").agg(cells.alias("cells")).select("kmer_id", F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), lambda o: F.coalesce(F.get(F.filter(F.map_entries("cells"), lambda e: e["key"] == o), F.lit(0))["value"], F.lit(0.0))).alias("vals"))


def keep_listed(matrix: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of the raw matrix whose feature is in the filtered one."""
    return matrix.join(listed.select("kmer_id").distinct(), "kmer_id", "left_semi")


def replicates(samples: DataFrame) -> DataFrame:
    """Running number of each sample in its group, by `ord`."""
    return samples.withColumn("replicate", F.row_number().over(Window.partitionBy("grp").orderBy("ord")))


def group_sizes(samples: DataFrame) -> DataFrame:
    return samples.groupBy("grp").agg(F.count("*").alias("n"))


def informative(matrix: DataFrame, most_zero: int) -> DataFrame:
    """Features with more than `most_zero` non-zero states."""
    keep = matrix.where("val <> 0").groupBy("kmer_id").agg(F.count("*").alias("n")).where(F.col("n") > most_zero)
    return matrix.join(keep.select("kmer_id"), "kmer_id", "left_semi")
