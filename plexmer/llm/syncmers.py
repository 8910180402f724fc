"""Document fingerprints from closed syncmers.

A k-mer here is `K` consecutive words; it is a closed syncmer when the smallest hash
among its inner substrings of `S` words is that of the first or the last one.  The
choice depends on the k-mer alone, so equal passages have equal anchors whatever
surrounds them.  A fingerprint is every anchor in text order, its hash and its place (the
number of its first word), in 16 hexadecimal digits, eight for each.  A hash has 32 bits: of two texts with n and m
anchors that share no word about n * m / 2**32 match by chance.  Anchors of two texts are matched by hash, equal
ones in the order of their places, which gives the pairs of places of what both share;
the likeness is matched anchors / all anchors of both (Jaccard similarity of the
multisets), without sampling.

All of it is built-in expressions: no Python runs on the executors.

Defined cases: null text is empty; an empty or blank text has an empty fingerprint; a
text without a closed syncmer (fewer than `K` words always, 5 or 6 words sometimes) has one anchor, its whole word sequence; likeness is 1
of two empty fingerprints and 0 of an empty and another; null doc_ids come first in
the order of documents, and rows of equal doc_id are ordered by text; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._ranges import bucket_of, id_splitters, wanted_buckets

K = 5
S = 2

#: Words; hash << 32 | place of the closed syncmers; the whole sequence where there is none.
_WORDS = r"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
_PLACED = """
element_at(transform(array({words}), ws ->
  IF(size(ws) = 0, CAST(array() AS ARRAY<BIGINT>),
  element_at(transform(array(IF(size(ws) < {k}, CAST(array() AS ARRAY<BIGINT>),
    element_at(transform(array(transform(sequence(0, size(ws) - {s}), i -> xxhash64({inner}))), p ->
      filter(transform(sequence(0, size(ws) - {k}), i ->
        IF(least(p[i], p[i + {last}]) <= least({between}), (xxhash64({cover}) & -4294967296L) | CAST(i AS BIGINT), CAST(NULL AS BIGINT))), x -> x IS NOT NULL)), 1))), found ->
    IF(size(found) = 0, array(xxhash64(concat_ws(' ', ws)) & -4294967296L), found)), 1))), 1)
"""
#: Anchors of both sorted by (hash, side, place) -> runs of one hash that both sides have -> pairs of places.
_PAIRS = """
element_at(transform(array(sort_array(concat({a}, transform({b}, x -> x | 2147483648L)))), c ->
  element_at(transform(array(filter(sequence(0, size(c)), i -> i = 0 OR i = size(c) OR shiftright(c[i], 32) <> shiftright(c[i - 1], 32))), at ->
    flatten(transform(filter(sequence(0, size(at) - 2), r -> at[r + 1] - at[r] > 1), r ->
      element_at(transform(array(transform(sequence(at[r], at[r + 1] - 1), i -> c[i])), run ->
        filter(zip_with(filter(run, x -> x & 2147483648L = 0), filter(run, x -> x & 2147483648L <> 0),
          (x, y) -> IF(x IS NULL OR y IS NULL, NULL, named_struct('a', CAST(x & 2147483647L AS INT), 'b', CAST(y & 2147483647L AS INT)))), z -> z IS NOT NULL)), 1)))), 1)), 1)
"""


def placed(text: str, k: int = K, s: int = S) -> Column:
    """Hash and place (number of the first word) of every closed syncmer of a string column, in text order, in one number each; 1 <= s <= k - 2."""
    if not 1 <= s <= k - 2:
        raise ValueError("inner substrings must be shorter than the k-mer by two words at least")
    inner = ", ".join(f"ws[i + {j}]" for j in range(s))
    between = ", ".join(f"p[i + {j}]" for j in ([*range(1, k - s)] * 2)[: max(2, k - s - 1)])  # least() takes two at least
    cover = ", ".join(f"p[i + {j}]" for j in sorted({*range(0, k - s + 1, s), k - s}))  # inner substrings that cover the k-mer
    return F.expr(_PLACED.format(words=_WORDS.format(text=f"coalesce({text}, '')"), k=k, s=s, last=k - s, inner=inner, between=between, cover=cover))


def anchors(text: str, k: int = K, s: int = S) -> Column:
    """Hashes of the closed syncmers of a string column, in text order."""
    return F.transform(placed(text, k, s), lambda x: F.shiftright(x, 32).cast("int"))


def written(of: str) -> Column:
    return F.expr(f"array_join(transform({of}, x -> lpad(hex(x), 16, '0')), '')")


def matches(a: str, b: str) -> Column:
    """Places (a, b) of the anchors that two columns of `placed` share: of one hash the first with the first, the second with the second and so on."""
    none = "CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>)"
    return F.expr(f"IF(size({a}) = 0 OR size({b}) = 0, {none}, {_PAIRS.format(a=a, b=b)})")


def likeness(a: str, b: str) -> Column:
    """Share of all anchors of both that match."""
    n, both = F.size(matches(a, b)), F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(n / (both - n))


def with_next(rows: DataFrame, values: list[str]) -> DataFrame:
    """`rows` with next_<value> of the following row by (doc_id, text), the first following the last.

    Rows go to ranges of doc_id; a range's first row goes to the range before it as
    well, so every row meets its successor in one sort, without one task for all.
    """
    cut = id_splitters(rows, "doc_id", wanted_buckets(rows.sparkSession))
    ends = rows.agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    first = [None] if ends["nulls"] else [ends["least"]]
    bucket, last = bucket_of(F.col("doc_id"), cut), len(cut)
    lowest = -1 if ends["nulls"] else 0
    # where else a row goes: (range, whether it wraps to the end)
    is_first = F.col("doc_id").isNull() if first[0] is None else F.col("doc_id") == F.lit(first[0])
    starts = F.col("doc_id").isin(cut) if cut else F.lit(False)
    if lowest == -1:
        starts = starts | (F.col("doc_id") == F.lit(ends["least"])) if ends["least"] is not None else starts
    here = F.struct(bucket.alias("bucket"), F.lit(0).alias("ghost"))
    before = F.when(starts & (bucket > lowest), F.array(F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("ghost")))).otherwise(F.array())
    around = F.when(is_first, F.array(F.struct(F.lit(last).alias("bucket"), F.lit(2).alias("ghost")))).otherwise(F.array())
    placed = rows.withColumn("to", F.explode(F.concat(F.array(here), before, around)))
    order = Window.partitionBy("to.bucket").orderBy("to.ghost", F.col("doc_id").asc_nulls_first(), "text")
    return placed.select("*", *(F.lead(v).over(order).alias(f"next_{v}") for v in values)).where("to.ghost = 0").drop("to")


def syncmer_fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of `docs` (doc_id, text): its fingerprint, that of its text spliced with the next document's, and likenesses."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = with_next(rows, ["text"])  # anchors are made after the shuffle, which moves texts only
    edited = near.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars - n_chars DIV 2 AS INT)), substring(next_text, 1, CAST(n_chars DIV 2 AS INT)))"))
    edited = edited.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), placed("text").alias("own"), placed("next_text").alias("next"), placed("edited").alias("after"))
    return edited.select("doc_id", "n_chars", "edited_sha256", written("own").alias("fingerprint"), written("after").alias("edited_fingerprint"), likeness("own", "after").alias("near_edited"), likeness("own", "next").alias("near_next"))
