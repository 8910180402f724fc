"""Exact dedup by sorting contents.

The order of rows is: first `PREFIX` characters of the normalised text, digest of the
whole text, whole text, identifier.  Equal texts are neighbours in it, by rising
identifier, and its keys are short, so sampled splitters (prefix, digest, identifier) of any texts
have a bounded size.  Splitters cut the rows into ranges; a text with very many copies is
cut by identifier over several ranges like anything else.  Each range is sorted externally
and neighbours are compared in full.  Then the last text of each range is compared in full with
the first of the next one, so that runs of equal texts that go on over ranges become
one: two rows a range, whatever the input holds.  The smallest identifier of a run stays.

Defined cases: null text counts as empty; null doc_ids sort last and stay only
where a group has no other id; repeated rows count as copies, and only one of those
with the smallest id has kept = true; very long texts are compared whole, and only the first and last of a range are
written besides the digests; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, materialise
from ._ranges import not_above, wanted_buckets

#: Characters of a text that lead the order.
PREFIX = 96
#: Sampled rows for each range; the driver holds this many splitter candidates times the ranges.
SAMPLES = 24
_LAST = 2**63 - 1


def normalised(text: str = "text") -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE, " ")


def _place(prefix: Column, digest: Column, doc_id: Column) -> Column:
    return F.struct(prefix.alias("prefix"), digest.alias("digest"), F.coalesce(doc_id, F.lit(_LAST)).cast("bigint").alias("id"))


def _splitters(rows: DataFrame, count: int, buckets: int) -> list[Column]:
    """Ascending literals (prefix, digest, id) that cut the rows into about equal ranges."""
    share = min(1.0, SAMPLES * buckets / max(1, count))
    norm = normalised()
    sample = rows.sample(share, seed=7).select(_place(F.substring(norm, 1, PREFIX), F.sha2(F.encode(norm, "UTF-8"), 256), F.col("doc_id")).alias("at"))
    ranked = sample.agg(F.array_sort(F.collect_list("at")).alias("all"))  # bounded: SAMPLES * buckets
    step = F.greatest(F.lit(1), F.floor(F.size("all") / buckets)).cast("int")
    cut = ranked.select(F.array_distinct(F.filter("all", lambda x, i: (i > 0) & (i % step == 0))).alias("cut")).first()["cut"]
    return [_place(F.lit(c["prefix"]), F.lit(c["digest"]), F.lit(c["id"])) for c in cut]


def _joined_runs(local: DataFrame) -> DataFrame:
    """bucket, run, all_keep, all_size, leads of the runs that go on over ranges, at most two rows a range."""
    ranges = local.where("edge IS NOT NULL").groupBy("bucket").agg(F.max_by("edge", "run").alias("tail"), F.min_by("edge", "run").alias("head"))
    # which range follows is found from numbers alone, a row a range; the texts then meet pair by pair
    follows = ranges.select("bucket").withColumn("next", F.lead("bucket").over(Window.orderBy("bucket")))
    goes_on = (
        follows.where("next IS NOT NULL").join(ranges.select("bucket", "tail"), "bucket").join(ranges.select(F.col("bucket").alias("next"), "head"), "next")
        .where(F.col("tail") == F.col("head")).select(F.col("next").alias("bucket"), F.lit(1).alias("run"), F.lit(0).alias("new"))
    )
    edges = local.where("edge IS NOT NULL").groupBy("bucket", "run").agg(F.first("keep").alias("keep"), F.first("size").alias("size"))
    order = Window.orderBy("bucket", "run")
    numbered = edges.join(goes_on, ["bucket", "run"], "left").withColumn("chain", F.sum(F.coalesce("new", F.lit(1))).over(order))
    chain = Window.partitionBy("chain")
    # a run's ranges follow each other by rising id, so its first range leads
    found = numbered.select("bucket", "run", F.min("keep").over(chain).alias("all_keep"), F.sum("size").over(chain).alias("all_size"), F.col("new").isNull().alias("leads"), F.count("*").over(chain).alias("n"))
    return found.where("n > 1").drop("n")


def content_sort_dedup(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs` (doc_id, text), and its columns `also`."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *also)
    cuts = _splitters(rows, rows.count(), wanted_buckets(docs.sparkSession))

    norm = rows.select("doc_id", normalised().alias("norm"), *also).withColumn("text_sha256", F.sha2(F.encode("norm", "UTF-8"), 256))
    prefix = F.substring("norm", 1, PREFIX)
    placed = norm.withColumn("prefix", prefix).withColumn("bucket", not_above(_place(prefix, F.col("text_sha256"), F.col("doc_id")), cuts))
    ordered = Window.partitionBy("bucket").orderBy("prefix", "text_sha256", "norm", F.col("doc_id").asc_nulls_last())
    before, after = F.lag("norm").over(ordered), F.lead("norm").over(ordered)
    sorted_rows = placed.select("bucket", "prefix", "doc_id", "norm", "text_sha256", (before.isNull() | (before != F.col("norm"))).cast("int").alias("start"), (before.isNull() | after.isNull()).alias("at_edge"), *also)
    runs = sorted_rows.select("bucket", "doc_id", "start", F.sum("start").over(ordered).alias("run"), "text_sha256", F.when(F.col("at_edge"), F.col("norm")).alias("edge"), *also)
    # the same partitioning holds, so only a sort of narrow rows is added
    own = Window.partitionBy("bucket", "run")
    local = materialise(runs.select("doc_id", "bucket", "run", "start", "text_sha256", "edge", F.min("doc_id").over(own).alias("keep"), F.count("*").over(own).alias("size"), *also), "runs")
    several = F.broadcast(materialise(_joined_runs(local), "joined"))  # two rows a range at most
    joined = local.drop("edge").join(several, ["bucket", "run"], "left")
    first = (F.col("start") == 1) & F.coalesce("leads", F.lit(True))
    keep = F.when(F.col("all_size").isNull(), F.col("keep")).otherwise(F.col("all_keep"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"), first.alias("kept"), "text_sha256", *also)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
             row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, sha256(norm) AS text_sha256 FROM g
"""
