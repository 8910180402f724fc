import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexmer.functions import kmers as K
from plexmer.operators import discretize, matrix, redundancy, runs, stats
from plexmer.plans import search
from plexmer.sources import files

X = np.array([1, 55, 2, 345, 512, 404, 2, 3, 5, 4, 23, 2], float)
Z = np.array([0, 0, 0, 0, 1, 1, 10, 11, 12, 13, 14, 15], float)
Y = np.repeat([0, 1], 6)


@pytest.mark.parametrize(("kmer", "number"), [("ACGT", 30), ("AACG", 7), ("CAAC", 65), ("GCAA", 208), ("TGCA", 180), ("G" * 30, 4**30 - 1), ("G" * 31, 4**31 - 1), ("ACTTTCTCCAGTCAGCCTCTACAGACCAAG", 119790575672176963)])
def test_encode_decode(spark, kmer, number):
    row = spark.range(1).select(K.encode(F.lit(kmer)).alias("n"), K.decode(K.encode(F.lit(kmer)), len(kmer)).alias("k")).first()
    assert (row["n"], row["k"]) == (number, kmer)


def test_canonical_and_windows(spark):
    row = spark.range(1).select(*(K.canonical(F.lit(k)).alias(k) for k in ("CGTT", "GTTG", "TTGC", "ACGT"))).first()
    assert list(row) == ["AACG", "CAAC", "GCAA", "ACGT"]
    seq = "ACGTN" + "ACCA" * 200
    got = spark.range(1).select(K.kmers(F.lit(seq), 4).alias("k"), K.kmers(F.lit("AC"), 4).alias("none")).first()
    assert got["k"] == [seq[i : i + 4] for i in range(len(seq) - 3) if "N" not in seq[i : i + 4]] and got["none"] == []


def test_discretisation_vectors():
    cuts, score, states = discretize.ameva(X, Y)
    assert cuts.tolist() == [1, 39, 512] and score == pytest.approx(3.0) and states.tolist() == [0, 1, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0]
    assert discretize.mdl(X, Y)[1].tolist() == [0] * 12
    cuts, score, states = discretize.ameva(Z, Y)
    assert cuts.tolist() == [0, 5.5, 15] and score == pytest.approx(6.0) and states.tolist() == [0] * 6 + [1] * 6
    cuts, states = discretize.mdl(Z, Y)
    assert cuts.tolist() == [5.5] and states.tolist() == [0] * 6 + [1] * 6


def test_anova(spark):
    cells = [(k, o, float(v)) for k, x in ((1, X), (2, Z)) for o, v in enumerate(x) if v]
    m = spark.createDataFrame(cells, "kmer_id bigint, ord int, val double")
    s = spark.createDataFrame([(o, int(g)) for o, g in enumerate(Y)], "ord int, grp int")
    got = {r["kmer_id"]: r["f"] for r in stats.anova(m, s).collect()}
    assert got[1] == pytest.approx(5.296334848357504) and got[2] == pytest.approx(235.79646017699068)
    assert stats.f_critical(4, 20, 0.05) == pytest.approx(2.866081402, abs=1e-8)
    assert [r["kmer_id"] for r in stats.anova_filter(m, s, 0.01).collect()] == [2]


def test_entropy_and_redundancy():
    assert stats.symmetric_uncertainty([0, 0, 1, 1, 2, 2], [0, 0, 1, 1, 1, 2]) == pytest.approx(0.7396673768007592)
    assert math.isnan(stats.symmetric_uncertainty([0, 0], [0, 0]))
    rng = np.random.default_rng(0)
    states = rng.integers(0, 3, (40, 12))
    kept = redundancy.greedy_keep(states, 2)
    assert all((states[a] != states[b]).sum() > 2 for a in kept for b in kept if a < b)


def test_redundancy_judges_equal_states_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    states = rng.choice(4, (300, 14), p=[0.55, 0.2, 0.15, 0.1])
    plain, table = [], redundancy.StateTable(states)
    for i in range(len(states)):
        others = np.array(plain, int)
        if not ((states[others] != states[i]).sum(axis=1) <= 2).any() and not (table.uncertainty(i, others) > 0.5).any():
            plain.append(i)
    assert 20 < len(plain) < 290 and redundancy.greedy_keep(states, 2, 0.5).tolist() == plain
    sizes, own = [], redundancy.StateTable
    monkeypatch.setattr(redundancy, "StateTable", lambda x: sizes.append(len(x)) or own(x))
    assert redundancy.greedy_keep(np.tile(states, (20, 1)), 2, 0.5).tolist() == plain and sizes == [len(np.unique(states, axis=0))]
    monkeypatch.undo()
    constant = np.ones((3, 5), int)
    assert redundancy.greedy_keep(constant, 0).tolist() == [0] and redundancy.greedy_keep(constant, -1).tolist() == [0, 1, 2]
    rows = [("b", i + 300 * c, [int(v) for v in x]) for c in range(3) for i, x in enumerate(states)]
    frame = spark.createDataFrame(rows, "bucket string, kmer_id bigint, states array<int>")
    assert sorted(r["kmer_id"] for r in redundancy.drop_redundant(frame, 2, 0.5).collect()) == plain


def test_ranks_and_roulette(spark):
    s = spark.createDataFrame([("r", i, v) for i, v in enumerate((0.9, 0.5, 0.9, 0.1))], "run string, ind int, score double")
    assert [r["rank"] for r in runs.fitness_rank(s).orderBy("ind").collect()] == [2, 3, 2, 4] == search.rank(np.array([0.9, 0.5, 0.9, 0.1])).tolist()
    got = runs.roulette(s).orderBy("rank").collect()
    assert sum(r["p"] for r in got) == pytest.approx(1) and got[-1]["cumulated"] == pytest.approx(1)
    row = spark.range(1).select(runs.composite_score(F.lit(0.9), F.lit(0.8), "adjust").alias("a"), runs.composite_score(F.lit(0.8), F.lit(0.9), "adjust").alias("b")).first()
    assert (row["a"], row["b"]) == (pytest.approx(0.62), pytest.approx(0.72))


def test_merge_metrics_of_level_runs(spark):
    of = lambda rows: runs.merge_metrics(spark.createDataFrame(rows, "kmer_id bigint, view double, viewinfold bigint")).first()
    level = of([(1, 60.0, 1), (2, 40.0, 1)])
    assert math.isnan(level["rank_corr"]) and (level["unique_percent"], level["shared_percent"]) == (100.0, 0.0)
    assert math.isnan(of([(1, 100.0, 2)])["rank_corr"]) and of([])["rank_corr"] is None
    assert of([(1, 50.0, 3), (2, 30.0, 1), (3, 20.0, 1)])["rank_corr"] == pytest.approx(np.corrcoef([1, 2, 3], [3, 1, 1])[0, 1])


def test_matrix_normalises_to_a_million(spark):
    reads = spark.createDataFrame([("a", "ACGTACGTTT"), ("b", "GGGTTTACAC")], "sample string, seq string")
    got = matrix.normalise(matrix.count_kmers(reads, 3), threshold=-1).groupBy("sample").agg(F.sum("val").alias("t")).collect()
    assert [r["t"] for r in got] == [pytest.approx(1e6)] * 2
    long = spark.createDataFrame([(7, 0, 2.0), (7, 2, 1.0)], "kmer_id bigint, ord int, val double")
    assert matrix.dense(long, 3).first()["vals"] == [2.0, 0.0, 1.0]


def test_partitions():
    groups, rng = np.repeat([0, 1], 30), np.random.default_rng(1)
    outer = search.outer_holdout(groups, 0.17, rng)
    assert [(outer[groups == g] == -1).sum() for g in (0, 1)] == [5, 5]
    state = search.rotate(groups, outer, 0.3, 3, rng)
    assert all(((state[groups == g] > 0) & (state[groups == g] >> r & 1 == 1)).sum() == 7 for g in (0, 1) for r in range(3)) and (state[outer == -1] == -1).all()


def test_search_finds_a_planted_feature(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.random(20).tolist()) for i in range(30)]
    rows[5] = (5, np.repeat([0.1, 5.0], 10).tolist())
    m = spark.createDataFrame(rows, "kmer_id bigint, vals array<double>")
    history = search.run(spark, m, ["a"] * 10 + ["b"] * 10, search.Config(individuals=20, generations=3, kmers=4, seed=2)).collect()
    assert history[-1]["best"] >= 0.9 and all(len(set(r["kmers"])) == 4 for r in history)


def test_files(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@r1\nACGT\n+\n@III\n@r2\nGG\n+\n@@\n")
    assert [(r["seq"], r["qual"]) for r in files.fastq(spark, str(tmp_path / "r.fastq")).orderBy("read_ix").collect()] == [("ACGT", "@III"), ("GG", "@@")]
    (tmp_path / "g.conf").write_text("p1\ta Yes\np2 b\tNo\n")
    assert [tuple(r) for r in files.group_config(spark, str(tmp_path / "g.conf")).collect()] == [(0, "p1", "a", "Yes"), (1, "p2", "b", "No")]
    (tmp_path / "m.tsv").write_text("\ts1\ts2\ngroup\tA\tB\n7\t1.5\tx\n")
    m, names, groups = files.matrix_text(spark, str(tmp_path / "m.tsv"))
    assert (names, groups, [tuple(r) for r in m.collect()]) == (["s1", "s2"], ["A", "B"], [(7, [1.5, 0.0])])
    assert files.settings("Kmer=5,10 # sizes\n#x=1\nmethod = linSVC") == {"kmer": ["5", "10"], "method": ["linSVC"]}
