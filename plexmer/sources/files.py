"""Readers of sequencing and matrix files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def group_config(spark: SparkSession, path: str) -> DataFrame:
    """Three white-space separated columns -> (ord, path, name, grp), in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).where(F.trim("line") != "")
    parts = F.split(F.trim("line"), r"\s+")
    return lines.select((F.row_number().over(Window.orderBy("i")) - 1).alias("ord"), parts[0].alias("path"), parts[1].alias("name"), parts[2].alias("grp"))  # a row a sample


def count_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="kmer string, cnt bigint").withColumn("file", F.input_file_name())


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, read_ix, name, seq, qual): four lines a record, whatever the lines begin with.

    Files are read in pieces, plain ones by several tasks: lines are numbered within the pieces, and the pieces by their lines.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), "value")
    numbered = lines.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33))
    # a row for each piece of a file
    counts = numbered.groupBy("file", "block", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = counts.select("file", "block", "part", "first", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    placed = numbered.join(F.broadcast(before), ["file", "block", "part"]).withColumn("line", F.col("id") - F.col("first") + F.col("before"))
    cell = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    reads = placed.groupBy("file", F.floor(F.col("line") / 4).alias("read_ix")).agg(F.substring(cell(0), 2, 1 << 30).alias("name"), cell(1).alias("seq"), cell(3).alias("qual"), F.count("*").alias("n"))
    return reads.where("n = 4").drop("n")


#: A read file's name: sample, mate and ending.
MATES = r"([^/]+?)[._-]R?([12])(?:_001)?\.f(?:ast)?q(?:\.gz)?$"


def fastq_pairs(spark: SparkSession, path: str, names: str = MATES) -> DataFrame:
    """Reads with sample and mate (1 or 2) from their files' names, so that mates of one number meet; files whose names say neither are their own sample's mate 1."""
    reads = fastq(spark, path)
    sample, mate = F.regexp_extract("file", names, 1), F.regexp_extract("file", names, 2)
    own = F.regexp_extract("file", r"([^/]+)$", 1)
    return reads.select(F.when(sample == "", own).otherwise(sample).alias("sample"), F.when(mate == "", 1).otherwise(mate.try_cast("int")).alias("mate"), "read_ix", "name", "seq", "qual")


def matrix_text(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """(kmer_id, vals), sample names, groups of a matrix with two header lines; cells that are no number are 0."""
    lines = spark.read.text(path)
    names, groups = (r["value"].split("\t")[1:] for r in lines.limit(2).collect())
    cells = F.split("value", "\t")
    body = lines.withColumn("id", cells[0].try_cast("bigint")).where(F.col("id").isNotNull())
    return body.select(F.col("id").alias("kmer_id"), F.transform(F.slice(cells, 2, len(names)), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))).alias("vals")), names, groups


def settings(text: str) -> dict[str, list[str]]:
    """key=value lines; keys without regard to case, # begins a comment, commas separate the values of a grid."""
    pairs = (re.sub(r"#.*", "", line).partition("=") for line in text.splitlines())
    return {k.strip().lower(): [x.strip() for x in v.split(",")] for k, eq, v in pairs if eq}
