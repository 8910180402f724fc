"""Report tables against plain versions, and binary matrices there and back."""

import collections
import random

import numpy as np
import pytest

from plexmer.operators import reports
from plexmer.sources import binary, files

IND = "run string, iter bigint, kmers array<bigint>, score double, outer double"


def individuals(spark, n=120):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, sorted(rng.sample(range(12 if i < 60 else 7), 3)), round(rng.random(), 2), round(rng.random(), 2)) for i in range(1, n)]
    return rows, spark.createDataFrame(rows, IND)


def test_settled(spark):
    rows, frame = individuals(spark)
    want = {}
    for run in "ab":
        def head(bound):
            counts = collections.Counter(k for r, i, kmers, *_ in rows if r == run and i <= bound for k in kmers)
            return {k for k, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]}

        last = max(i for r, i, *_ in rows if r == run)
        want[run] = next(b for b in range(10, last + 11, 10) if len(head(b) & head(10**9)) >= 4)
    assert {r["run"]: r["bound"] for r in reports.settled(frame, 10, 5, 4).collect()} == want
    assert reports.settled(frame.limit(0), 10).count() == 0


def test_filters_and_ranks(spark):
    rows, frame = individuals(spark)
    assert reports.good_individuals(frame, 0.5, 0.5).count() == sum(r[3] >= 0.5 and r[4] >= 0.5 for r in rows) and reports.good_individuals(frame, 0.5).count() == sum(r[3] >= 0.5 for r in rows)
    assert {tuple(r) for r in reports.latest(frame).collect()} == {(x, max(r[1] for r in rows if r[0] == x)) for x in "ab"}
    scores = spark.createDataFrame([("r", 2, 0.5), ("r", 1, 0.5), ("r", 3, 0.9)], "run string, ind int, score double")
    assert [r["ind"] for r in reports.unique_rank(scores).orderBy("rank").collect()] == [3, 1, 2]
    sets = [("r", 1, [1, 2], 0.9), ("r", 1, [3, 4], 0.8), ("r", 2, [3, 4], 0.2), ("r", 2, [5, 6], 0.1), ("r", 2, [7, 8], 0.05)]
    got = reports.imported_individuals(spark.createDataFrame(sets, "run string, iter int, kmers array<int>, score double"), 2, 0.1).collect()
    assert {(tuple(r["kmers"]), r["nview"], r["score"]) for r in got} == {((1, 2), 1, 0.9), ((3, 4), 2, 0.8)}


def test_correlations(spark):
    rng = np.random.default_rng(1)
    table = [(i, float(a), float(a * (1 if i < 20 else -1) + 0.1 * b)) for i, (a, b) in enumerate(rng.random((40, 2)))]
    frame = spark.createDataFrame([("g", *r) for r in table], "by string, i int, x double, y double")
    got = reports.quarter_correlations(frame, "by", "i", "x", "y").first()
    of = lambda part: np.corrcoef([r[1] for r in part], [r[2] for r in part])[0, 1]
    assert (got["whole"], got["first"], got["last"]) == (pytest.approx(of(table)), pytest.approx(of(table[1:10])), pytest.approx(of(table[-10:-1])))
    pairs = {(r["setting"], r["outcome"]): r["corr"] for r in reports.correlation_table(frame, ["x", "i"], ["y"]).collect()}
    assert pairs["x", "y"] == pytest.approx(of(table)) and len(pairs) == 2
    assert reports.thinned(frame, "by", "i", 8).count() == 8 and reports.thinned(frame, "by", "i", 100).count() == 40


def test_small_tables(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([9, 8, 7, 6, 5, 4, 5, 3, 2, 1, 0, 0])], "i int, n int")
    assert reports.neighbour_cut(counts) == 5 and reports.neighbour_cut(counts.limit(10)) is None
    frame = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],), ([5.0],), ([],)], "v array<double>")
    assert [round(r[0], 6) for r in frame.select(reports.binary_entropy(frame["v"], 2.5)).collect()] == [0.811278, 0.0, 0.0]
    log = spark.createDataFrame([("r", 1, "a", "x"), ("r", 3, "b", "y")], "run string, gen int, feature string, value string")
    gens = spark.createDataFrame([("r", i) for i in range(1, 4)], "run string, gen int")
    assert [tuple(r)[2:] for r in reports.filled_log(log, gens, ["a", "b"]).orderBy("gen").collect()] == [("x", "NA"), ("NA", "NA"), ("NA", "y")]


@pytest.mark.parametrize("slice_rows", [0, 7, 50])
def test_binary_matrices(spark, tmp_path, slice_rows):
    rng = np.random.default_rng(4)
    rows = {int(i): rng.random(3).astype(np.float32).astype(float).tolist() for i in range(1, 2000, 59)}
    frame = spark.createDataFrame(list(rows.items())[::-1], "kmer_id bigint, vals array<double>")
    path, names, groups = f"file://{tmp_path}/m.bin", ["a", "bé", "c"], ["x", "y", "y"]
    binary.write_binary(frame, names, groups, path, slice_rows)
    head = binary.head_of(path)
    assert (head.rows, head.names, head.groups, head.slice_rows) == (len(rows), names, groups, slice_rows)
    got = binary.read_binary(spark, path, rows_a_task=10).orderBy("row").collect()
    assert [(r["kmer_id"], r["vals"]) for r in got] == sorted(rows.items())
    key, values = binary.row_at(path, 8)
    assert values.tolist() == rows[key] and binary.cell_at(path, 8, 2) == rows[key][2] and key == sorted(rows)[8]
    assert [tuple(r) for r in binary.samples_of(spark, path).collect()] == [(0, "a", "x"), (1, "bé", "y"), (2, "c", "y")]
    part, samples = binary.submatrix(frame, binary.samples_of(spark, path), spark.createDataFrame([(key,)], "kmer_id bigint"), ["y"])
    assert [tuple(r) for r in part.collect()] == [(key, rows[key][1:])] and samples.count() == 2
    (tmp_path / "text").write_text("id\ta\tb\n" * 9)
    assert binary.head_of(f"{tmp_path}/text") is None
    with pytest.raises(ValueError):
        binary.write_binary(frame, ["x" * 65, "b", "c"], groups, path)
    binary.write_binary(frame.limit(0), names, groups, path)
    assert binary.read_binary(spark, path).count() == 0


def test_paired_reads(spark, tmp_path):
    for name, text in (("s1.R1", "@a\nAC\n+\nII\n@b\nGG\n+\nII\n"), ("s1.R2", "@a\nTT\n+\nII\n@b\nCC\n+\nII\n"), ("s2_R1", "@c\nA\n+\n@\n")):
        (tmp_path / f"{name}.fastq").write_text(text)
    pairs = files.fastq_pairs(spark, f"file://{tmp_path}/*.fastq").orderBy("sample", "read_ix", "mate").collect()
    assert [(r["sample"], r["mate"], r["read_ix"], r["seq"]) for r in pairs] == [("s1", 1, 0, "AC"), ("s1", 2, 0, "TT"), ("s1", 1, 1, "GG"), ("s1", 2, 1, "CC"), ("s2", 1, 0, "A")]
