"""Queries of the library's own operators over the driver tables, and their DuckDB SQL.

Bindings: a feature is a part, a sample a nation, a group a region, a value the
quantity ordered; texts folded to four letters are reads and sources their samples; users
are individuals, event types runs and hours iterations; orders are sets of parts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kmers as K
from .operators import clustering, cuts, discretize, evaluation, history, manifold, matrix, redundancy, reports, runs, stats
from .plans import comparison, search

K_DNA = 6


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("grp"))


def long_matrix(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = _t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("l_partkey").alias("kmer_id"), F.col("c_nationkey").alias("ord")).agg(F.sum("l_quantity").alias("val"))


def _spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores where the files have fewer pieces than there are cores; large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def reads(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(_t(spark, sf, "documents").select("source", "text")).select(F.col("source").alias("sample"), K.fold_text(F.col("text")).alias("seq"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    events = _t(spark, sf, "events")
    return events.groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("ind")).agg(F.max("value").alias("score"))


def individuals(spark: SparkSession, sf: str) -> DataFrame:
    genes = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("kmers"))
    return genes.join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("run"), F.col("l_orderkey").alias("iter"), "kmers", F.col("o_totalprice").alias("score"))


def run_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return runs.occurrences(individuals(spark, sf), "run")


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


_M = """m AS (SELECT l_partkey AS kmer_id, c_nationkey AS ord, sum(l_quantity) AS val
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
_ANOVA = _M + """, z AS (SELECT n_regionkey AS grp, count(*) AS n FROM nation GROUP BY 1),
c AS (SELECT kmer_id, n_regionkey AS grp, sum(val) AS s, sum(val * val) AS q FROM m JOIN nation ON n_nationkey = ord GROUP BY 1, 2),
u AS (SELECT kmer_id, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM c JOIN z USING (grp) GROUP BY 1),
t AS (SELECT sum(n) AS n, count(*) AS g FROM z),
f AS (SELECT kmer_id, ((b - s * s / n) / (g - 1)) / nullif((q - b) / (n - g), 0) AS f FROM u, t)"""
_FOLD = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACTGACTGACTGACTGACTGACTGAC')"
_KMERS = f"""r AS (SELECT source AS sample, {_FOLD} AS seq FROM documents),
w AS (SELECT sample, unnest(list_transform(range(1, CAST(length(seq) - {K_DNA} + 2 AS BIGINT)), lambda i: substr(seq, i, {K_DNA}))) AS kmer FROM r WHERE length(seq) >= {K_DNA}),
k AS (SELECT sample, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS cnt FROM w GROUP BY 1, 2)"""
_ID = " + ".join(f"(position(substr(kmer, {i + 1}, 1) IN 'ACTG') - 1) * {4 ** (K_DNA - 1 - i)}" for i in range(K_DNA))
_S = "s AS (SELECT event_type AS run, user_id AS ind, max(value) AS score FROM events GROUP BY 1, 2)"
_I = "i AS (SELECT o_orderpriority AS run, l_orderkey AS iter, kmers, o_totalprice AS score FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS kmers FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey)"
_O = _I + ", o AS (SELECT run, unnest(kmers) AS kmer_id, score FROM i), q AS (SELECT run, kmer_id, count(*) AS nview, sum(score) AS score_cum FROM o GROUP BY 1, 2)"
_RANK = "k AS (SELECT *, count(*) OVER (PARTITION BY run) + 1 - rank() OVER (PARTITION BY run ORDER BY score) AS rank FROM s)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@_query(f"WITH {_ANOVA} SELECT kmer_id, round(f, 6) AS f FROM f")
def anova_features(spark, sf):
    return _r(stats.anova(long_matrix(spark, sf), samples(spark, sf)), "f")


@_query(f"WITH {_ANOVA} SELECT kmer_id, round(f, 6) AS f FROM f WHERE f IS NULL OR f >= 2.8660814020156584")
def anova_filter(spark, sf):
    return _r(stats.anova_filter(long_matrix(spark, sf), samples(spark, sf), 0.05), "f")


@_query(f"WITH {_KMERS} SELECT sample, kmer, cnt FROM k")
def kmer_counts(spark, sf):
    return matrix.count_kmers(reads(spark, sf), K_DNA)


@_query(f"WITH {_KMERS} SELECT DISTINCT kmer, CAST({_ID} AS BIGINT) AS kmer_id, kmer AS decoded FROM k")
def kmer_encode_decode(spark, sf):
    found = matrix.count_kmers(reads(spark, sf), K_DNA).select("kmer").distinct().withColumn("kmer_id", K.encode(F.col("kmer")))
    return found.withColumn("decoded", K.decode(F.col("kmer_id"), K_DNA))


@_query(f"WITH {_KMERS}, t AS (SELECT sample, sum(cnt) AS total FROM k GROUP BY 1) SELECT sample, CAST({_ID} AS BIGINT) AS kmer_id, round(cnt * 1e6 / total, 6) AS val FROM k JOIN t USING (sample) WHERE cnt > 5")
def kmer_matrix(spark, sf):
    return _r(matrix.normalise(matrix.count_kmers(reads(spark, sf), K_DNA), 5), "val")


@_query("SELECT n_regionkey AS grp, count(*) AS n FROM nation GROUP BY 1")
def group_sizes(spark, sf):
    return matrix.group_sizes(samples(spark, sf))


@_query("SELECT n_nationkey AS ord, n_name AS name, n_regionkey AS grp, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS replicate FROM nation")
def replicate_numbers(spark, sf):
    return matrix.replicates(samples(spark, sf)).withColumn("replicate", F.col("replicate").cast("bigint"))


_DENSE = _M + ", d AS (SELECT kmer_id, list_transform(range(25), lambda o: coalesce(map_extract(c, CAST(o AS INT))[1], 0)) AS vals FROM (SELECT kmer_id, map_from_entries(list((ord, val))) AS c FROM m GROUP BY 1))"


@_query(f"WITH {_DENSE} SELECT kmer_id, array_to_string(list_transform(vals, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS vals FROM d")
def dense_matrix(spark, sf):
    m = long_matrix(spark, sf)
    merged = matrix.merge(m.where("ord < 10"), m.where("ord >= 10"))
    return matrix.dense(merged, 25).select("kmer_id", F.array_join(F.transform("vals", lambda v: v.cast("bigint").cast("string")), ",").alias("vals"))


@_query(f"WITH {_M} SELECT kmer_id, ord, round(val, 6) AS val FROM m WHERE kmer_id IN (SELECT kmer_id FROM m WHERE val <> 0 GROUP BY 1 HAVING count(*) > 15)")
def informative_features(spark, sf):
    return _r(matrix.informative(long_matrix(spark, sf), 15), "val")


@_query(f"WITH {_ANOVA}, keep AS (SELECT kmer_id FROM f WHERE f IS NULL OR f >= 2.8660814020156584) SELECT kmer_id, ord, round(val, 6) AS val FROM m WHERE kmer_id IN (SELECT kmer_id FROM keep)")
def real_counts(spark, sf):
    m = long_matrix(spark, sf)
    return _r(matrix.keep_listed(m, stats.anova_filter(m, samples(spark, sf), 0.05)), "val")


def _dense_with(spark, sf):
    return matrix.dense(long_matrix(spark, sf), 25)


def _groups(spark, sf) -> list[str]:
    return [str(r["grp"]) for r in samples(spark, sf).orderBy("ord").collect()]


@_query()
def discretise_ameva(spark, sf):
    return discretize.discretise(_dense_with(spark, sf), _groups(spark, sf), "ameva")


@_query()
def discretise_mdl(spark, sf):
    return discretize.discretise(_dense_with(spark, sf), _groups(spark, sf), "mdl")


@_query(f"""WITH {_DENSE}, b AS (SELECT kmer_id, p_brand, p_size, list_transform(vals, lambda v: CAST(v > 0 AS INT)) AS st FROM d JOIN part ON p_partkey = kmer_id)
SELECT a.kmer_id AS id1, b.kmer_id AS id2, CAST(len(list_filter(list_zip(a.st, b.st), lambda p: p[1] <> p[2])) AS INT) AS distance FROM b a JOIN b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.kmer_id < b.kmer_id""")
def hamming_in_buckets(spark, sf):
    b = _dense_with(spark, sf).join(_t(spark, sf, "part"), F.col("p_partkey") == F.col("kmer_id")).select("kmer_id", "p_brand", "p_size", F.transform("vals", lambda v: (v > 0).cast("int")).alias("st"))
    other = b.select(F.col("kmer_id").alias("id2"), "p_brand", "p_size", F.col("st").alias("st2"))
    return b.join(other, ["p_brand", "p_size"]).where("kmer_id < id2").select(F.col("kmer_id").alias("id1"), "id2", redundancy.hamming(F.col("st"), F.col("st2")).alias("distance"))


@_query()
def redundancy_filter(spark, sf):
    b = _dense_with(spark, sf).join(_t(spark, sf, "part"), F.col("p_partkey") == F.col("kmer_id"))
    return redundancy.drop_redundant(b.select(F.col("p_brand").alias("bucket"), "kmer_id", F.transform("vals", lambda v: F.width_bucket(v, F.lit(0.0), F.lit(100.0), F.lit(4)).cast("int")).alias("states")), 1)


@_query(f"WITH {_S}, {_RANK} SELECT run, ind, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM k")
def fitness_rank(spark, sf):
    return _r(runs.fitness_rank(scores(spark, sf)), "score").withColumn("rank", F.col("rank").cast("bigint"))


@_query(f"""WITH {_S}, {_RANK}, a AS (SELECT run, min(score) - 2 * median(score) AS g, sum(score) AS t, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT run, ind, rank, (score + g) / nullif(t + n * g, 0) AS p FROM k JOIN a USING (run))
SELECT run, ind, CAST(rank AS BIGINT) AS rank, round(p, 6) AS p, round(sum(p) OVER (PARTITION BY run ORDER BY rank RANGE UNBOUNDED PRECEDING), 6) AS cumulated FROM p""")
def roulette(spark, sf):
    return _r(runs.roulette(scores(spark, sf)), "p", "cumulated").select("run", "ind", F.col("rank").cast("bigint").alias("rank"), "p", "cumulated")


@_query(f"WITH {_S} SELECT run, round(avg(score), 6) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, ind) AS r FROM s) WHERE r <= 10 GROUP BY 1")
def top10_mean(spark, sf):
    return _r(runs.top_mean(scores(spark, sf)), "top_mean")


@_query(f"WITH {_S} SELECT run, ind, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, ind) AS r FROM s) WHERE r = 1")
def winners(spark, sf):
    return _r(runs.winner(scores(spark, sf)), "score")


@_query(f"WITH {_O} SELECT kmer_id, CAST(sum(nview) AS BIGINT) AS nview, round(sum(score_cum), 2) AS score_cum FROM q GROUP BY 1")
def kmer_occurrences(spark, sf):
    return _r(runs.occurrences(individuals(spark, sf)), "score_cum", digits=2)


@_query(f"WITH {_O}, g AS (SELECT kmer_id, sum(nview) AS nview FROM q GROUP BY 1) SELECT kmer_id, CAST(nview AS BIGINT) AS nview FROM g WHERE nview > 2 * (SELECT avg(nview) FROM g)")
def mean_cut(spark, sf):
    return runs.mean_cut(runs.occurrences(individuals(spark, sf))).select("kmer_id", "nview")


@_query(f"""WITH {_O}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY nview DESC, kmer_id) AS r FROM q),
h AS (SELECT run, kmer_id, 100.0 * nview / sum(nview) OVER (PARTITION BY run) AS share FROM r WHERE r <= 200)
SELECT kmer_id, round(sum(share) / (SELECT count(DISTINCT run) FROM q), 6) AS view, count(*) AS viewinfold FROM h GROUP BY 1""")
def merged_runs(spark, sf):
    return _r(runs.merge_runs(run_occurrences(spark, sf), 200), "view")


@_query(f"""WITH {_O}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY nview DESC, kmer_id) AS r FROM q),
h AS (SELECT run, kmer_id, 100.0 * nview / sum(nview) OVER (PARTITION BY run) AS share FROM r WHERE r <= 200),
v AS (SELECT kmer_id, sum(share) / (SELECT count(DISTINCT run) FROM q) AS view, count(*) AS f FROM h GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY round(view, 9) DESC, kmer_id) AS r FROM v)
SELECT round(corr(r, f), 6) AS rank_corr, round(100.0 * count(*) / sum(f), 6) AS unique_percent, round(100 * avg(CAST(f > 1 AS INT)), 6) AS shared_percent FROM k""")
def merge_metrics(spark, sf):
    return _r(runs.merge_metrics(runs.merge_runs(run_occurrences(spark, sf), 200)), "rank_corr", "unique_percent", "shared_percent")


@_query(f"""WITH {_O}, n AS (SELECT run, count(*) AS n FROM q GROUP BY 1)
SELECT a.run AS run1, b.run AS run2, count(*) AS shared, round(count(*) / least(any_value(x.n), any_value(y.n)), 6) AS ratio
FROM q a JOIN q b ON a.kmer_id = b.kmer_id AND a.run < b.run JOIN n x ON x.run = a.run JOIN n y ON y.run = b.run GROUP BY 1, 2""")
def run_overlap(spark, sf):
    return _r(runs.run_overlap(run_occurrences(spark, sf)), "ratio")


@_query(f"""WITH {_I} SELECT individual, round(max(score), 2) AS score, count(*) AS nbview FROM (SELECT array_to_string(list_sort(list_transform(kmers, lambda x: CAST(x AS VARCHAR))), ',') AS individual, score FROM i) GROUP BY 1 ORDER BY max(score) DESC, 1 LIMIT 50""")
def top_individuals(spark, sf):
    return _r(runs.top_distinct(individuals(spark, sf), 50), "score", digits=2)


@_query(f"WITH {_I}, f AS (SELECT kmer_id, min(iter) AS first FROM (SELECT iter, unnest(kmers) AS kmer_id FROM i) GROUP BY 1) SELECT CAST(floor(first / 500) AS BIGINT) AS bin, count(*) AS new_kmers FROM f GROUP BY 1")
def first_seen(spark, sf):
    return runs.first_seen(individuals(spark, sf), 500)


_NET = _I + ", e AS (SELECT id1, id2, max(score) AS w_max, avg(score) AS w_avg, sum(score) AS w_sum FROM (SELECT score, id1, unnest(kmers) AS id2 FROM (SELECT score, unnest(kmers) AS id1, kmers FROM i)) WHERE id1 < id2 GROUP BY 1, 2)"


@_query(f"WITH {_NET} SELECT id1, id2, round(w_max, 2) AS w_max, round(w_avg, 4) AS w_avg, round(w_sum, 2) AS w_sum FROM e")
def kmer_network(spark, sf):
    return _r(_r(runs.network(individuals(spark, sf)), "w_max", "w_sum", digits=2), "w_avg", digits=4)


@_query(f"WITH {_NET} SELECT kmer_id, round(sum(w_sum), 2) AS strength FROM (SELECT id1 AS kmer_id, w_sum FROM e UNION ALL SELECT id2, w_sum FROM e) GROUP BY 1")
def node_strength(spark, sf):
    return _r(runs.strength(runs.network(individuals(spark, sf))), "strength", digits=2)


@_query("""SELECT vec_id, round(n, 4) AS norm, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / nullif(n, 0) * 1.0)), 4) AS total
FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)""")
def l2_normalise(spark, sf):
    e = _t(spark, sf, "embeddings").withColumn("n", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    unit = e.withColumn("u", F.transform("embedding", lambda x: F.try_divide(x.cast("double"), F.col("n"))))
    return _r(unit.select("vec_id", F.col("n").alias("norm"), F.aggregate("u", F.lit(0.0), lambda s, x: s + x).alias("total")), "norm", "total", digits=4)


_Q = _O + ", g AS (SELECT kmer_id, CAST(sum(nview) AS BIGINT) AS nview FROM q GROUP BY 1)"


@_query(f"WITH {_I} SELECT kmer_id, count(*) AS nview FROM (SELECT unnest(kmers) AS kmer_id FROM i WHERE iter <= 5000) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def bounded_histogram(spark, sf):
    return history.bounded_histogram(individuals(spark, sf), 5000, 100)


@_query(f"""WITH {_I}, e AS (SELECT iter, unnest(kmers) AS kmer_id FROM i), z AS (SELECT max(iter) AS z FROM i),
f AS (SELECT kmer_id FROM e GROUP BY 1 ORDER BY count(*) DESC, kmer_id LIMIT 100),
b AS (SELECT unnest(range(1, CAST(floor(z / 1000) AS BIGINT) + 1)) * 1000 AS bound FROM z),
c AS (SELECT bound, kmer_id, row_number() OVER (PARTITION BY bound ORDER BY count(*) DESC, kmer_id) AS r FROM b JOIN e ON iter <= bound GROUP BY 1, 2)
SELECT bound AS iter, (SELECT count(*) FROM f) - count(f.kmer_id) AS distance FROM b LEFT JOIN c USING (bound) LEFT JOIN f ON f.kmer_id = c.kmer_id AND r <= 100 GROUP BY 1""")
def head_distances(spark, sf):
    return history.head_distances(individuals(spark, sf), 1000, 100)


@_query(f"WITH {_I} SELECT CAST(floor(iter / 500) AS BIGINT) AS bin, round(max(score), 2) AS score FROM i WHERE score >= 1000 GROUP BY 1")
def bin_maxima(spark, sf):
    return _r(history.bin_maxima(individuals(spark, sf), 500, 1000), "score", digits=2)


@_query(f"""WITH {_I}, e AS (SELECT run, iter, unnest(kmers) AS kmer_id, unnest(range(len(kmers))) AS pos FROM i), f AS (SELECT run, kmer_id, min(iter * 1000 + pos) AS first FROM e GROUP BY 1, 2)
SELECT run, kmer_id, CAST(dense_rank() OVER (PARTITION BY run ORDER BY first) AS INT) AS appearance FROM f""")
def appearance(spark, sf):
    return history.appearance(individuals(spark, sf))


@_query(f"WITH {_I} SELECT run, iter, round(score, 2) AS score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY iter DESC) - 1 AS b FROM i) WHERE b % 100 = 0")
def strided_history(spark, sf):
    return _r(history.strided(individuals(spark, sf), 100), "score", digits=2).select("run", "iter", "score")


@_query(f"""WITH {_I}, t AS (SELECT run, iter, kmers, unnest(kmers) AS kmer_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, iter) AS r FROM i) WHERE r <= 200)
SELECT a.run, a.iter AS iter1, b.iter AS iter2, round(count(*) / greatest(len(a.kmers), len(b.kmers)), 6) AS similarity FROM t a JOIN t b ON a.run = b.run AND a.kmer_id = b.kmer_id AND a.iter < b.iter GROUP BY a.run, a.iter, b.iter, a.kmers, b.kmers""")
def similar_individuals(spark, sf):
    return _r(history.similar_individuals(history.best_individuals(individuals(spark, sf), 200)), "similarity")


@_query(f"""WITH {_O}, r AS (SELECT run, kmer_id, row_number() OVER (PARTITION BY run ORDER BY nview DESC, kmer_id) AS r FROM q QUALIFY r <= 300),
p AS (SELECT x.run AS run1, y.run AS run2, x.r AS r1, y.r AS r2 FROM r x JOIN r y ON x.kmer_id = y.kmer_id AND x.run < y.run),
d AS (SELECT a.run1, a.run2, count(*) AS n FROM p a JOIN p b ON a.run1 = b.run1 AND a.run2 = b.run2 AND a.r1 < b.r1 AND a.r2 > b.r2 GROUP BY 1, 2)
SELECT run1, run2, CAST(count(*) AS INT) AS shared, CAST(coalesce(any_value(n), 0) AS INT) AS discordant FROM p LEFT JOIN d USING (run1, run2) GROUP BY 1, 2""")
def kendall_distance(spark, sf):
    return history.kendall(run_occurrences(spark, sf), 300)


@_query("SELECT l_linenumber AS gen, round(corr(l_quantity, l_extendedprice), 6) AS corr, round(avg(l_quantity - l_extendedprice), 4) AS difference FROM lineitem GROUP BY 1")
def score_correlations(spark, sf):
    lines = _t(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "gen")
    return _r(_r(history.correlations(lines, "gen", "l_quantity", "l_extendedprice"), "corr"), "difference", digits=4)


@_query(f"WITH {_O}, a AS (SELECT DISTINCT kmer_id FROM q WHERE run = '1-URGENT'), b AS (SELECT DISTINCT kmer_id FROM q WHERE run = '5-LOW') SELECT (SELECT count(*) FROM a) AS size_a, (SELECT count(*) FROM a SEMI JOIN b USING (kmer_id)) AS both, (SELECT count(*) FROM b) AS size_b")
def list_overlap(spark, sf):
    occ = run_occurrences(spark, sf)
    return history.list_overlap(occ.where("run = '1-URGENT'"), occ.where("run = '5-LOW'"))


@_query(f"WITH {_O} SELECT run, round(avg(nview), 6) AS mean, max(nview) AS most, round(stddev_pop(nview), 6) AS deviation FROM q GROUP BY 1")
def view_profile(spark, sf):
    return _r(cuts.view_profile(run_occurrences(spark, sf)), "mean", "deviation")


@_query(f"WITH {_Q}, z AS (SELECT min(nview) AS l, max(nview) AS h FROM g) SELECT CAST(least(20, floor((nview - l) * 20 / coalesce(nullif(h - l, 0), 1)) + 1) AS INT) AS bin, count(*) AS n FROM g, z GROUP BY 1")
def view_bins(spark, sf):
    return cuts.view_bins(runs.occurrences(individuals(spark, sf)))


@_query(f"""WITH {_M}, f AS (SELECT n_nationkey AS ord FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ORDER BY 1 LIMIT 6),
c AS (SELECT * FROM m SEMI JOIN f USING (ord) WHERE val <> 0), k AS (SELECT kmer_id FROM c GROUP BY 1 HAVING (SELECT count(*) FROM f) - count(*) >= (SELECT count(*) - floor(count(*) / 3) FROM f)),
h AS (SELECT val, count(*) AS n FROM c SEMI JOIN k USING (kmer_id) GROUP BY 1) SELECT coalesce(max(val) FILTER (n >= 0.02 * (SELECT sum(n) FROM h)), -1.0) AS threshold FROM h""")
def noise_threshold(spark, sf):
    return spark.createDataFrame([(cuts.noise_threshold(long_matrix(spark, sf), samples(spark, sf)),)], "threshold double")


@_query()
def winner_cut(spark, sf):
    return cuts.winner_cut(runs.occurrences(individuals(spark, sf))).select("kmer_id", "nview")


@_query()
def slope_cut(spark, sf):
    return cuts.slope_cut(runs.occurrences(individuals(spark, sf))).select("kmer_id", "nview")


@_query(f"""WITH {_DENSE}, c AS (SELECT kmer_id, n_regionkey AS grp, ord, val FROM (SELECT kmer_id, unnest(vals) AS val, unnest(range(25)) AS ord FROM d) JOIN nation ON n_nationkey = ord),
h AS (SELECT *, median(val) OVER (PARTITION BY kmer_id, grp) AS mid FROM c), k AS (SELECT *, median(abs(val - mid)) OVER (PARTITION BY kmer_id, grp) AS mad FROM h)
SELECT kmer_id, CAST(ord AS INT) AS ord, round(coalesce((val - mid) / nullif(mad, 0), 0), 6) AS spread FROM k""")
def group_spread(spark, sf):
    return _r(cuts.group_spread(_dense_with(spark, sf), samples(spark, sf)), "spread")


@_query(f"""WITH {_M}, s AS (SELECT kmer_id, sum(val) AS total FROM m GROUP BY 1), c AS (SELECT total, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT total, CAST(floor((sum(n) OVER (ORDER BY total) - 1) / (SELECT max(n) FROM c)) AS BIGINT) AS bucket FROM c) SELECT kmer_id, total, bucket FROM s JOIN p USING (total)""")
def sum_buckets(spark, sf):
    return cuts.sum_buckets(long_matrix(spark, sf))


@_query(f"""WITH {_DENSE}, r AS (SELECT kmer_id, round(list_avg(vals) / nullif(list_var_samp(vals), 0), 9) AS ratio FROM d), w AS (SELECT kmer_id, ratio FROM r WHERE ratio IS NOT NULL),
b AS (SELECT kmer_id, ratio, CAST(floor((rank() OVER (ORDER BY ratio) - 1) * 20 / count(*) OVER ()) AS BIGINT) AS bin FROM w)
SELECT kmer_id, ratio, bin, round((ratio - avg(ratio) OVER (PARTITION BY bin)) / nullif(stddev_samp(ratio) OVER (PARTITION BY bin), 0), 4) AS z FROM b""")
def variability(spark, sf):
    return _r(cuts.variability(_dense_with(spark, sf)), "z", digits=4)


_DIST = _M + """, x AS (SELECT a.ord AS o1, b.ord AS o2, sum(a.val * b.val) AS dot FROM m a JOIN m b USING (kmer_id) GROUP BY 1, 2),
y AS (SELECT p.o1, p.o2, sqrt(u.dot + v.dot - 2 * p.dot) AS dist FROM x p JOIN x u ON u.o1 = p.o1 AND u.o2 = p.o1 JOIN x v ON v.o1 = p.o2 AND v.o2 = p.o2 WHERE p.o1 <> p.o2)"""
_KNN = _DIST + """, w AS (SELECT o1, n_regionkey AS vote, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o1 ORDER BY round(dist, 6), o2) AS r FROM y) JOIN nation ON n_nationkey = o2 WHERE r <= 5 GROUP BY 1, 2),
v AS (SELECT o1 AS ord, n_regionkey AS grp, vote AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY o1 ORDER BY n DESC, vote) AS r FROM w) JOIN nation ON n_nationkey = o1 WHERE r = 1)"""


@_query(f"WITH {_DIST} SELECT o1 AS ord1, o2 AS ord2, round(dist, 4) AS distance FROM y")
def sample_distances(spark, sf):
    return _r(evaluation.sample_distances(long_matrix(spark, sf), samples(spark, sf)), "distance", digits=4)


def _predictions(spark, sf):
    return evaluation.nearest_vote(evaluation.sample_distances(long_matrix(spark, sf), samples(spark, sf)), samples(spark, sf))


@_query(f"WITH {_KNN} SELECT ord, grp, predicted FROM v")
def nearest_vote(spark, sf):
    return _predictions(spark, sf)


@_query(f"WITH {_KNN} SELECT grp, predicted, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY grp), 6) AS percent FROM v GROUP BY 1, 2")
def confusion(spark, sf):
    return _r(evaluation.confusion(_predictions(spark, sf)), "percent")


@_query(f"""WITH {_DIST}, h AS (SELECT o1, p.n_regionkey AS g1, q.n_regionkey AS g2, avg(dist) AS d FROM y JOIN nation p ON p.n_nationkey = o1 JOIN nation q ON q.n_nationkey = o2 GROUP BY 1, 2, 3),
s AS (SELECT o1 AS ord, max(d) FILTER (g1 = g2) AS a, min(d) FILTER (g1 <> g2) AS b FROM h GROUP BY 1) SELECT ord, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / nullif(greatest(a, b), 0) END, 6) AS silhouette FROM s""")
def silhouette(spark, sf):
    return _r(evaluation.silhouette(evaluation.sample_distances(long_matrix(spark, sf), samples(spark, sf)), samples(spark, sf)), "silhouette")


_PR = """s AS (SELECT lang AS cls, n_chars AS score, toxic AS label FROM documents JOIN labels USING (doc_id)), c AS (SELECT cls, score, sum(label) AS hits, count(*) AS n FROM s GROUP BY 1, 2),
p AS (SELECT cls, score, sum(hits) OVER w / sum(n) OVER w AS precision, sum(hits) OVER w / nullif(sum(hits) OVER (PARTITION BY cls), 0) AS recall FROM c WINDOW w AS (PARTITION BY cls ORDER BY score DESC))"""


def _scored(spark, sf):
    labelled = _t(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, sf, "labels"), "doc_id")
    return labelled.select(F.col("lang").alias("cls"), F.col("n_chars").alias("score"), F.col("toxic").alias("label"))


@_query(f"WITH {_PR} SELECT cls, score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM p")
def precision_recall(spark, sf):
    return _r(evaluation.precision_recall(_scored(spark, sf)), "precision", "recall")


@_query(f"WITH {_PR} SELECT cls, round(sum(precision * rise), 6) AS average_precision FROM (SELECT *, recall - coalesce(lag(recall) OVER (PARTITION BY cls ORDER BY score DESC), 0) AS rise FROM p) GROUP BY 1")
def average_precision(spark, sf):
    return _r(evaluation.average_precision(_scored(spark, sf)), "average_precision")


@_query("""WITH c AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS axis FROM embeddings),
s AS (SELECT label, axis, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM c GROUP BY 1, 2), a AS (SELECT axis, sum(s) AS s, sum(q) AS q, sum(n) AS n, sum(s * s / n) AS b, count(*) AS k FROM s GROUP BY 1)
SELECT round((sum(b - s * s / n) / (max(k) - 1)) / nullif(sum(q - b) / (max(n) - max(k)), 0), 4) AS calinski_harabasz FROM a""")
def cluster_separation(spark, sf):
    return _r(evaluation.calinski_harabasz(_t(spark, sf, "embeddings").select(F.col("label").alias("grp"), F.col("embedding").alias("vals"))), "calinski_harabasz", digits=4)


@_query()
def feature_search(spark, sf):
    """A seeded search over the dense matrix at the operator's defaults: the history of its generations."""
    m = long_matrix(spark, sf)
    return search.run(spark, matrix.dense(m, 25), _groups(spark, sf), search.Config())


@_query(f"""WITH {_I}, v AS (SELECT run, CAST(ceil(iter / 1000.0) AS BIGINT) AS bin, kmer_id, count(*) AS n FROM (SELECT run, iter, unnest(kmers) AS kmer_id FROM i) GROUP BY 1, 2, 3),
b AS (SELECT run, unnest(range(1, greatest(max(bin), 1) + 1)) AS bound FROM v GROUP BY run),
h AS (SELECT b.run, bound, kmer_id, row_number() OVER (PARTITION BY b.run, bound ORDER BY sum(n) DESC, kmer_id) AS r FROM b JOIN v ON v.run = b.run AND v.bin <= bound GROUP BY 1, 2, 3),
f AS (SELECT run, kmer_id, row_number() OVER (PARTITION BY run ORDER BY sum(n) DESC, kmer_id) AS r FROM v GROUP BY 1, 2)
SELECT run, CAST(min(bound) * 1000 AS BIGINT) AS bound FROM (SELECT h.run, bound FROM h JOIN f ON f.run = h.run AND f.kmer_id = h.kmer_id AND f.r <= 5 WHERE h.r <= 5 GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1""")
def settled_heads(spark, sf):
    return reports.settled(individuals(spark, sf), 1000, 5, 2)


@_query(f"WITH {_S} SELECT run, ind, round(score, 6) AS score, row_number() OVER (PARTITION BY run ORDER BY score DESC, ind) AS rank FROM s")
def unique_rank(spark, sf):
    return _r(reports.unique_rank(scores(spark, sf)), "score").withColumn("rank", F.col("rank").cast("bigint"))


@_query(f"WITH {_I} SELECT run, max(iter) AS iter FROM i GROUP BY 1")
def latest_iteration(spark, sf):
    return reports.latest(individuals(spark, sf))


@_query(f"WITH {_O} SELECT kmer_id, CAST(sum(nview) AS BIGINT) AS nview, round(sum(score_cum) / sum(nview), 2) AS mean_score FROM q GROUP BY 1")
def mean_scores(spark, sf):
    return _r(reports.mean_scores(run_occurrences(spark, sf)), "mean_score", digits=2)


@_query(f"WITH {_I} SELECT run, iter, round(score, 2) AS score FROM i WHERE score >= 300000")
def good_individuals(spark, sf):
    return _r(reports.good_individuals(individuals(spark, sf), 300000).select("run", "iter", "score"), "score", digits=2)


@_query(f"""WITH {_I}, d AS (SELECT run, iter, len(kmers) AS n, score, row_number() OVER (PARTITION BY run ORDER BY iter) - 1 AS i, count(*) OVER (PARTITION BY run) AS c FROM i),
e AS (SELECT *, floor(c / 4) AS q FROM d)
SELECT run, round(corr(n, score), 6) AS whole, round(corr(n, score) FILTER (WHERE i >= 1 AND i < q), 6) AS first, round(corr(n, score) FILTER (WHERE i >= c - q AND i < c - 1), 6) AS last FROM e GROUP BY 1""")
def quarter_correlations(spark, sf):
    rows = individuals(spark, sf).select("run", "iter", F.size("kmers").cast("double").alias("n"), "score")
    return _r(reports.quarter_correlations(rows, "run", "iter", "n", "score"), "whole", "first", "last")


@_query("""WITH r AS (SELECT user_id, count(*) AS events, avg(value) AS mean, max(value) AS most FROM events GROUP BY 1)
SELECT 'events' AS setting, 'mean' AS outcome, round(corr(events, mean), 6) AS corr FROM r UNION ALL SELECT 'events', 'most', round(corr(events, most), 6) FROM r""")
def setting_correlations(spark, sf):
    table = _t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return _r(reports.correlation_table(table, ["events"], ["mean", "most"]), "corr")


@_query(f"""WITH {_O}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY nview DESC, kmer_id) AS r FROM q),
h AS (SELECT run, kmer_id, 100.0 * nview / sum(nview) OVER (PARTITION BY run) AS share FROM r WHERE r <= 200),
v AS (SELECT kmer_id, sum(share) / (SELECT count(DISTINCT run) FROM q) AS view, count(*) AS viewinfold FROM h GROUP BY 1),
t AS (SELECT * FROM v ORDER BY round(view, 9) DESC, kmer_id LIMIT 40)
SELECT kmer_id, round(view, 6) AS view, run, nview FROM q JOIN t USING (kmer_id)""")
def top_with_runs(spark, sf):
    occ = run_occurrences(spark, sf)
    return _r(reports.top_with_runs(runs.merge_runs(occ, 200), occ), "view")


@_query(f"WITH {_M}, d AS (SELECT kmer_id, count(*) FILTER (WHERE val > 50) / 25.0 AS p FROM m GROUP BY 1) SELECT kmer_id, round(CASE WHEN p IN (0, 1) THEN 0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END, 6) AS entropy FROM d")
def feature_entropy(spark, sf):
    return _r(matrix.dense(long_matrix(spark, sf), 25).select("kmer_id", reports.binary_entropy(F.col("vals"), 50.0).alias("entropy")), "entropy")


@_query(f"WITH {_I}, f AS (SELECT c AS kmer_id, count(*) AS nview FROM (SELECT l_suppkey % 97 * (l_linenumber % 3) AS c FROM lineitem) GROUP BY 1) SELECT kmer_id, nview FROM f WHERE nview > 2 * (SELECT avg(nview) FROM f)")
def mean_cut_of_uneven_views(spark, sf):
    """Views with a heavy head, so that the cut keeps rows."""
    occ = _t(spark, sf, "lineitem").select((F.col("l_suppkey") % 97 * (F.col("l_linenumber") % 3)).alias("kmer_id")).groupBy("kmer_id").agg(F.count("*").alias("nview"))
    return runs.mean_cut(occ)


def _supplier_table(spark, sf):
    """Samples (nations) by 40 features, a bounded table that one task holds."""
    dense = matrix.dense(long_matrix(spark, sf), 25)
    chosen = dense.orderBy("kmer_id").limit(40).collect()
    return np.log1p(np.array([r["vals"] for r in chosen], float).T), [r["grp"] for r in samples(spark, sf).orderBy("ord").collect()]


@_query(None)
def classifier_report(spark, sf):
    x, groups = _supplier_table(spark, sf)
    return comparison.report(comparison.predictions(spark, x, [str(g) for g in groups]))


@_query(None)
def sample_embeddings(spark, sf):
    x, _ = _supplier_table(spark, sf)
    rows = [(m, i, float(a), float(b)) for m in manifold.METHODS for i, (a, b) in enumerate(manifold.embed(m, x, 2, 8))]
    return spark.createDataFrame(rows, "method string, ord int, x double, y double")


@_query(None)
def sample_clusters(spark, sf):
    x, _ = _supplier_table(spark, sf)
    rows = [(m, i, int(c)) for m in clustering.METHODS for i, c in enumerate(clustering.cluster(m, x, 5))]
    return spark.createDataFrame(rows, "method string, ord int, cluster int")
