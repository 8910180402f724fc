"""Writers of matrices, lists and run logs, and the readers of the same files.

Tables that other queries read belong in Parquet; these formats exchange data with other tools.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kmers as K
from .files import matrix_text


def write_matrix(dense: DataFrame, names: list[str], groups: list[str], path: str) -> None:
    """(kmer_id, vals) as tab-separated text under `path`/part=head (two lines) and `path`/part=rows; numbers as Spark prints doubles."""
    spark = dense.sparkSession
    head = spark.createDataFrame([("\t".join(["", *names]),), ("\t".join(["group", *groups]),)], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/part=head")
    rows = dense.select(F.concat_ws("\t", F.col("kmer_id").cast("string"), F.transform("vals", lambda v: v.cast("string"))).alias("value"))
    rows.write.mode("overwrite").text(f"{path}/part=rows")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """What `write_matrix` wrote: (kmer_id, vals), sample names, groups."""
    _, names, groups = matrix_text(spark, f"{path}/part=head")
    cells = F.split("value", "\t")
    rows = spark.read.text(f"{path}/part=rows")
    return rows.select(cells[0].cast("bigint").alias("kmer_id"), F.transform(F.slice(cells, 2, len(names)), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))).alias("vals")), names, groups


def sample_rows(dense: DataFrame, samples: DataFrame, listed: list[int]) -> DataFrame:
    """(ord, grp, vals): a row a sample with the values of the listed features in the list's order, 0 where one is missing.

    The list is short enough for one row to hold; features that are not listed are never shuffled.
    """
    places = dense.sparkSession.createDataFrame([(int(k), i) for i, k in enumerate(listed)], "kmer_id bigint, pos int")
    cells = dense.join(F.broadcast(places), "kmer_id").select("pos", F.posexplode("vals").alias("ord", "val"))
    found = cells.groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("pos", "val"))).alias("cells"))
    every = F.transform(F.sequence(F.lit(0), F.lit(len(listed) - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0)))
    return samples.select("ord", "grp").join(found, "ord", "left").select("ord", "grp", (every if listed else F.array().cast("array<double>")).alias("vals"))


def drop_group(dense: DataFrame, samples: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """The matrix and its samples without one group; the rest is numbered anew."""
    kept = [r for r in samples.orderBy("ord").collect() if str(r["grp"]) != group]  # a row a sample
    rows = dense.select("kmer_id", F.transform(F.array(*(F.lit(r["ord"]) for r in kept)), lambda o: F.get("vals", o)).alias("vals"))
    return rows, samples.sparkSession.createDataFrame([(i, str(r["grp"])) for i, r in enumerate(kept)], "ord int, grp string")


def list_rows(matrix: DataFrame, occ: DataFrame, least: int = 0) -> DataFrame:
    """Matrix rows of an occurrence list whose summed views reach `least`, most viewed first, with their views."""
    listed = occ.groupBy("kmer_id").agg(F.sum("nview").alias("nview")).where(F.col("nview") >= least)
    return matrix.join(listed, "kmer_id").orderBy(F.desc("nview"), "kmer_id")


def fasta(listed: DataFrame, k: int) -> DataFrame:
    """(kmer_id) -> (value): a header line and the sequence, ready for `write.text`."""
    return listed.select(F.concat(F.lit("> "), F.col("kmer_id").cast("string"), F.lit("\n"), K.decode(F.col("kmer_id"), k)).alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, kmer_id) of the sequence lines."""
    kmer = F.upper(F.trim("value"))
    return spark.read.text(path).where(~F.col("value").startswith(">") & (F.trim("value") != "")).select(kmer.alias("kmer"), K.encode(kmer).alias("kmer_id"))


def kmer_size(numbered: DataFrame) -> int:
    """Shortest k whose identifiers cover all of (kmer_id); 0 of an empty table.  Leading letters of digit 0 can't be seen."""
    most = numbered.agg(F.max("kmer_id")).first()[0]
    size = 0
    while most is not None and (size == 0 or most >= 4**size):
        size += 1
    return size


def occurrence_list(occ: DataFrame, path: str) -> None:
    """id,count,score lines, most viewed first; k-mers never viewed are left out."""
    occ.where("nview > 0").orderBy(F.desc("nview"), "kmer_id").select("kmer_id", "nview", "score_cum").write.mode("overwrite").csv(path)


def read_occurrence_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="kmer_id bigint, nview bigint, score_cum double")


def population(individuals: DataFrame, path: str) -> None:
    """One individual a line, its k-mers joined by commas."""
    individuals.select(F.array_join(F.transform("kmers", lambda k: k.cast("string")), ",").alias("value")).write.mode("overwrite").text(path)


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """(kmers); cells that are no number are left out, and so are empty lines."""
    kmers = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull())
    return spark.read.text(path).select(kmers.alias("kmers")).where(F.size("kmers") > 0)


def read_good_individuals(spark: SparkSession, path: str) -> DataFrame:
    """(iter, kmers, test, outer) of tab-separated lines."""
    lines = spark.read.csv(path, sep="\t", schema="iter bigint, ids string, test double, outer double")
    return lines.select("iter", F.transform(F.split("ids", ","), lambda x: F.trim(x).try_cast("bigint")).alias("kmers"), "test", "outer")


def run_log(history: DataFrame) -> DataFrame:
    """(run, gen, features map) -> one JSON document (value) a run: {"run": {gen: features}}."""
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("gen").cast("string").alias("gen"), "features")))
    return history.groupBy("run").agg(F.to_json(F.struct(entries.alias("run"))).alias("value"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, gen, features) of whole JSON logs, generations numbered from 1; those without a best score ("NA") are left out."""
    logs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "run map<string, map<string, string>>").alias("log"))
    rows = logs.select("file", F.explode("log.run").alias("gen", "features")).withColumn("gen", F.col("gen").cast("bigint"))
    least = rows.groupBy("file").agg(F.min("gen").alias("least"))
    return rows.where(F.coalesce(F.try_element_at("features", F.lit("scoremax")), F.lit("NA")) != "NA").join(least, "file").select("file", (F.col("gen") - F.col("least") + 1).alias("gen"), "features")
