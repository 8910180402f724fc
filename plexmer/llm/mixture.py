"""Mixing sources to target weights by pivotal dependent rounding.

Sizes are words.  Sources in code-point order (null last) weigh 1, 2, 3, repeating;
their targets share all words by weight, stop at `MOST` times the source's size, and
the excess is shared anew by weight until none is above.  Each document of a source
is due ``target / source size`` copies; the whole part is certain, and the
fractional parts are rounded by the pivotal method: two documents meet, one passes
words to the other at random until one of them is all in or all out, and the rest goes
on.  A meeting keeps the sum of words due, and on average what each document is due.

Meetings are in an order that ends with small documents.  Documents meet in `ROUNDS` rounds by their share of
the source's words, the largest first.  In a round every document meets others of about its
size in blocks of about `FAN_IN`; each block leaves one residual, and residuals meet in blocks again
until one is left for each source (a reduction tree).  The last residual of a round meets
all documents of the later rounds as one body: it becomes integral, and what the body
passes changes the due of all of its documents evenly.  So the words of a source miss its target by
the last residual of its last round at most, a document of about the smallest size it has.

Randomness is a hash of ids, sizes and a seed, and the order of meetings is fixed, so
reruns agree, whatever the partitioning.  Sources stay in tables; a few sums of all of them go through the driver.

Defined cases: null text has size 0 (it takes part in rounding, no word depends on it); null doc_ids are ids like any
other; rows equal in doc_id, source and size are counted first and rounded one by one, each under a number of its own; an empty table gives an
empty result; a source without words has target 0 and takes 0; other columns are
ignored by the plan and kept by `apply_mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import MOST_NOTED, SPACE, materialise, materialise_at, place, shuffle_width, with_row_id, with_values

MOST = 3
FAN_IN = 128
#: Rounds, each for documents down to a `STEP`-th of the share of the one before.
ROUNDS = 7
STEP = 4
UNIT = 1 << 30
#: Equal rows that one row of the count stands for are written out in runs of this length.
RUN = 4096


def n_words(text: str = "text") -> Column:
    """Number of words: the pieces between white space that are not empty."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE), lambda w: w != "")).cast("bigint")


#: aggregate() over items (m, c, h, row), m of c due, in 2**-30 words: `held` keeps a fraction, `out` gets the rows that became integral.
_ROW = "STRUCT<doc_id: BIGINT, size: BIGINT, nth: BIGINT>"
_ITEM = f"STRUCT<m: BIGINT, c: BIGINT, h: BIGINT, row: {_ROW}>"
_TO_HELD, _TO_NEXT = "least(s.held.c - s.held.m, x.m)", "least(s.held.m, x.c - x.m)"
_PIVOT = f"""
aggregate(items,
  CAST(named_struct('held', null, 'out', array()) AS STRUCT<held: {_ITEM}, out: ARRAY<STRUCT<one: INT, row: {_ROW}>>>),
  (s, x) -> CASE
    WHEN x.m = 0 THEN named_struct('held', s.held, 'out', array_append(s.out, named_struct('one', 0, 'row', x.row)))
    WHEN s.held IS NULL THEN named_struct('held', x, 'out', s.out)
    ELSE element_at(transform(
      array(IF(x.h % ({_TO_HELD} + {_TO_NEXT}) < {_TO_NEXT}, {_TO_HELD}, -{_TO_NEXT})),
      d -> named_struct(
        'held', CASE
          WHEN s.held.m + d NOT IN (0, s.held.c) THEN named_struct('m', s.held.m + d, 'c', s.held.c, 'h', s.held.h, 'row', s.held.row)
          WHEN x.m - d NOT IN (0, x.c) THEN named_struct('m', x.m - d, 'c', x.c, 'h', x.h, 'row', x.row) END,
        'out', concat(s.out,
          filter(array(named_struct('one', CASE s.held.m + d WHEN 0 THEN 0 WHEN s.held.c THEN 1 END, 'row', s.held.row),
                       named_struct('one', CASE x.m - d WHEN 0 THEN 0 WHEN x.c THEN 1 END, 'row', x.row)), o -> o.one IS NOT NULL)))), 1)
  END)
"""


def ranked_sources(rows: DataFrame) -> DataFrame:
    """source, source_size, weight for every source of `rows` (source, size, n); numbered in ranges, not in one task."""
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by = F.col("source").asc_nulls_last()
    placed = materialise(found.repartitionByRange(shuffle_width(rows.sparkSession), by).withColumn("part", F.spark_partition_id()), "sources")
    # a row for each range
    counts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1 + F.col("before")
    return placed.join(F.broadcast(counts), "part").select("source", "source_size", (1 + number % 3).alias("weight"))


def with_targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """`sources` (source, source_size, weight) with target; each round of sharing is one aggregate."""
    goal = lambda left, weight: F.lit(float(left)) * F.col("weight") / F.lit(weight)
    limit = F.lit(float(most)) * F.col("source_size")
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left, weight, stopped = whole["size"] or 0, whole["weight"] or 1, 0
    while True:
        above = goal(left, weight) > limit
        found = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("source_size"))).alias("size"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if (found["n"] or 0) <= stopped or not found["weight"]:
            return sources.withColumn("target", F.when(above, limit).otherwise(goal(left, weight)))
        stopped, left, weight = found["n"], (whole["size"] or 0) - most * found["size"], found["weight"]


def _tree(items: DataFrame, classes: DataFrame, levels: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """(source, one, row) of the documents that meetings made integral, and the last residual of each source (source, m, c, h, row)."""
    items = items.join(classes, items["source"].eqNullSafe(classes["c_source"]) & (items["k"] == classes["klass"])).select(
        "source", "m", "c", "row", F.expr("`from` + pmod(xxhash64(row.doc_id, row.size, row.nth, h), blocks)").alias("block"), "h"
    )
    done = residual = None
    for level in range(levels + 1):
        if level:
            # the residuals of FAN_IN neighbouring blocks meet
            items = residual.select("source", "m", "c", "row", F.expr(f"block DIV {FAN_IN}").alias("block"), F.expr(f"shiftrightunsigned(xxhash64(row.doc_id, row.size, h, {level}L), 1)").alias("h"))
        group = items.groupBy("source", "block").agg(F.expr("array_sort(collect_list(named_struct('size', row.size, 'doc_id', row.doc_id, 'nth', row.nth, 'm', m, 'c', c, 'h', h, 'row', row)))").alias("items"))
        group = group.withColumn("items", F.expr("transform(items, x -> named_struct('m', x.m, 'c', x.c, 'h', x.h, 'row', x.row))")).withColumn("r", F.expr(_PIVOT))
        group = materialise(group.select("source", "block", "r"), f"{tag}-{level}")
        out = group.select("source", F.inline("r.out"))
        done = out if done is None else done.unionByName(out)
        residual = group.where("r.held IS NOT NULL").select("source", "block", "r.held.m", "r.held.c", "r.held.h", "r.held.row")
    return done, residual


def mix(docs: DataFrame, most: float = MOST, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of `docs` (doc_id, text, source)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"))
    rows = materialise(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = materialise(with_targets(ranked_sources(rows), most).select(F.col("source").alias("s"), "source_size", "target"), "targets")
    same = F.col("source").eqNullSafe(F.col("s"))

    share = F.lit(0)
    for i in range(1, ROUNDS):
        share = share + (F.col("size").cast("double") * STEP**i <= F.col("source_size")).cast("int")
    # size classes a twelfth of a doubling wide, numbered in order; each has blocks of about FAN_IN documents
    klass = F.floor(F.log2(F.col("size") + 1) * 12).cast("int")
    placed = rows.join(sources.select("s", "source_size"), same).select("doc_id", "source", "size", "n", share.alias("round"), klass.alias("k"))
    classes = placed.groupBy("round", F.col("source").alias("c_source"), F.col("k").alias("klass")).agg(F.ceil(F.sum("n") / FAN_IN).alias("blocks"), F.sum(F.col("size") * F.col("n")).alias("words"))
    classes = materialise(classes.withColumn("from", F.sum("blocks").over(Window.partitionBy("round", "c_source").orderBy("klass")) - F.col("blocks")), "classes")
    most_blocks = dict(classes.groupBy("round", "c_source").agg(F.sum("blocks").alias("n")).groupBy("round").agg(F.max("n")).collect())  # a number for each round

    # what is left of the target, and the words it is left for
    state = sources.select("s", F.col("target").alias("left"), F.col("source_size").alias("words"))
    counted = []
    for i in sorted(most_blocks):
        due = F.coalesce(F.least(F.lit(most * float(UNIT)), F.greatest(F.lit(0.0), F.round(F.try_divide("left", "words") * UNIT))).cast("bigint"), F.lit(0))
        state = materialise(state.withColumn("due", due).select("s", "left", "words", F.expr(f"due DIV {UNIT}L").alias("whole"), F.expr(f"due % {UNIT}L").alias("part")), f"due{i}")
        own = placed.where(F.col("round") == i).withColumn("nth", F.explode(F.expr(f"sequence(0L, (n - 1) DIV {RUN})")))
        own = own.withColumn("nth", F.explode(F.expr(f"sequence(nth * {RUN}, least(n, (nth + 1) * {RUN}) - 1)")))
        items = own.join(state, same).select(
            "source", "k", (F.col("part") * F.col("size")).alias("m"), (F.lit(UNIT).cast("bigint") * F.col("size")).alias("c"), F.struct("doc_id", "size", "nth").alias("row"),
            F.expr(f"shiftrightunsigned(xxhash64(doc_id, size, nth, {seed}L), 1)").alias("h"),
        )
        levels = math.ceil(math.log(most_blocks[i], FAN_IN) - 1e-9)
        done, residual = _tree(items, classes.where(F.col("round") == i), levels, f"round{i}")
        # the residual meets the body of all later documents, which takes up the difference
        done = done.unionByName(residual.select("source", F.expr("IF(h % c < m, 1, 0)").alias("one"), "row"))
        done = done.join(state.select("s", "whole"), same).select("source", "row", (F.col("whole") + F.col("one")).alias("copies"))
        # each round is written, so that no later plan holds its meetings once more
        done, folder = materialise_at(done, f"done{i}")
        counted.append(folder)
        if i != max(most_blocks):
            taken = done.groupBy(F.col("source").alias("t")).agg(F.sum(F.col("copies") * F.col("row.size")).alias("taken"), F.sum("row.size").alias("met"))
            state = state.join(taken, F.col("s").eqNullSafe(F.col("t")), "left").select("s", (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left"), (F.col("words") - F.coalesce("met", F.lit(0))).alias("words"))
    if counted:
        counted = docs.sparkSession.read.schema(done.schema).parquet(*counted)
    else:
        counted = rows.select("source", F.struct("doc_id", "size", F.lit(0).cast("bigint").alias("nth")).alias("row"), F.lit(0).cast("bigint").alias("copies"))
    counted = counted.join(sources, same).select("row.doc_id", "source", "row.size", "source_size", "target", "copies")
    return counted.withColumn("taken", F.col("copies") * F.col("size"))


def numbered(rows: DataFrame, keys: list[str], row: str, ways: int = 64) -> DataFrame:
    """`rows` with nth, the number from 1 of each among those of its keys (which may be null); a key's rows are numbered in `ways` parts."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64(row), F.lit(ways)).cast("int"))
    counts = part.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    counts = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(row)) + F.col("_before")
    return part.join(counts, same).select(*rows.columns, nth.alias("nth"))


def apply_mix(docs: DataFrame, most: float = MOST, seed: int = 0) -> DataFrame:
    """`docs` with every row repeated as often as the mix takes it; rows taken 0 times go."""
    key = ["_id", "_source", "_size"]
    with_id = with_row_id(docs, "mixed")
    rows = with_id.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("source").cast("string").alias("_source"), n_words().alias("_size"), F.col("row_id").alias("_row"))
    # of equal rows so many get each number of copies: a few numbers a key
    plan = mix(docs, most, seed).groupBy("doc_id", "source", "size", "copies").agg(F.count("*").alias("n"))
    plan = plan.groupBy("doc_id", "source", "size").agg(F.array_sort(F.collect_list(F.struct("copies", "n"))).alias("plan"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size"))
    at = F.expr("aggregate(plan, named_struct('before', 0L, 'copies', 0L), (s, x) -> IF(nth > s.before, named_struct('before', s.before + x.n, 'copies', x.copies), s))")["copies"]
    chosen = numbered(rows, key, "_row").join(plan, same).select(F.col("_row").alias("row_id"), at.cast("int").alias("_copies")).where("_copies > 0")
    if most < MOST_NOTED:
        file, number = place("row_id")
        taken = with_values(with_id, (file, number), chosen.select(file.alias("file"), number.alias("number"), F.col("_copies").alias("value")), "chosen")
        taken = taken.withColumnRenamed("_value", "_copies").where("_copies > 0")
    else:
        taken = with_id.join(materialise(chosen, "chosen"), "row_id")
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*docs.columns)
