"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as a Parquet table with the columns of
documents; the last returns the packed pieces.

Defined cases: rows are told apart by their place in the stage's input, so null and repeated ids, and repeated rows, are decided one by
one; null and empty texts are no toxic ones, are copies of each other in the exact stage and of nothing in the near one, and are packed as
their end id; a source of null is one source; other columns are kept up to the last stage; an empty table gives an empty result; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmer.llm._common import materialise, place, with_row_id, with_values
from plexmer.llm.content_sort import content_sort_dedup
from plexmer.llm.mixture import apply_mix
from plexmer.llm.ngram_join import ngram_jaccard_join
from plexmer.llm.packing import harmonic_pack
from plexmer.llm.toxicity import toxicity

#: SQL can't express the toxicity model, the random mixture or the tokenizer.
ORACLE_SQL = None


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose row_id is not in `dropped`, without it.

    What goes is written first, a byte a row: it is decided once, and texts are not shuffled.
    """
    file, number = place("row_id")
    gone = dropped.select(file.alias("file"), number.alias("number"), F.lit(1).alias("value"))
    return with_values(rows, (file, number), gone, "dropped").where("_value = 0").drop("row_id", "_value")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model (5) does not reject."""
    rows = with_row_id(docs, "rows")
    scored = toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), also=("row_id",))
    return without(rows, scored.where("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (8)."""
    rows = with_row_id(docs, "rows")
    return without(rows, content_sort_dedup(rows, also=("row_id",)).where("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest id, of each group linked by the n-gram join (2): five words, similarity 0.8 or more."""
    rows = with_row_id(docs, "rows")
    groups = ngram_jaccard_join(rows, n=5, num=4, den=5, pool=6, also=("row_id",)).select("component", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id").alias("row"))
    groups = materialise(groups, "groups")
    first = groups.groupBy("component").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first")
    return without(rows, groups.join(first, "component").where("row.row_id <> first.row_id").select("row.row_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the mixture (6) takes them."""
    return apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences (3)."""
    return harmonic_pack(docs, end_id=1).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixture", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
