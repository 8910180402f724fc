import json

import pytest

from plexmer.sources import writers as W


@pytest.fixture
def dense(spark):
    return spark.createDataFrame([(7, [1.5, 0.0, 2.0]), (27, [0.0, 4.0, 1.0])], "kmer_id bigint, vals array<double>")


@pytest.fixture
def samples(spark):
    return spark.createDataFrame([(0, "A"), (1, "B"), (2, "A")], "ord int, grp string")


def test_matrix_files(spark, dense, samples, tmp_path):
    W.write_matrix(dense, ["x", "y", "z"], ["A", "B", "A"], f"{tmp_path}/m")
    rows, names, groups = W.read_matrix(spark, f"{tmp_path}/m")
    assert (names, groups, sorted(map(tuple, rows.collect()))) == (["x", "y", "z"], ["A", "B", "A"], sorted(map(tuple, dense.collect())))
    got = {r["ord"]: (r["grp"], r["vals"]) for r in W.sample_rows(dense, samples, [27, 5, 7]).collect()}
    assert got == {0: ("A", [0.0, 0.0, 1.5]), 1: ("B", [4.0, 0.0, 0.0]), 2: ("A", [1.0, 0.0, 2.0])}
    assert {tuple(r["vals"]) for r in W.sample_rows(dense, samples, []).collect()} == {()}
    rows, left = W.drop_group(dense, samples, "A")
    assert sorted(map(tuple, rows.collect())) == [(7, [0.0]), (27, [4.0])] and [tuple(r) for r in left.collect()] == [(0, "B")]
    occ = spark.createDataFrame([(7, 2, 1.0), (27, 5, 2.5), (9, 0, 0.0)], "kmer_id bigint, nview bigint, score_cum double")
    assert [r["kmer_id"] for r in W.list_rows(dense, occ, 1).collect()] == [27, 7]
    W.occurrence_list(occ, f"{tmp_path}/o")
    assert sorted(map(tuple, W.read_occurrence_list(spark, f"{tmp_path}/o").collect())) == [(7, 2, 1.0), (27, 5, 2.5)]


def test_lists_and_logs(spark, dense, tmp_path):
    W.fasta(dense, 5).write.text(f"{tmp_path}/f")
    assert sorted(map(tuple, W.read_fasta(spark, f"{tmp_path}/f").collect())) == [("AAACG", 7), ("AACTG", 27)]
    assert W.kmer_size(dense) == 3 and W.kmer_size(dense.limit(0)) == 0 and W.kmer_size(spark.createDataFrame([(4**30 - 1,)], "kmer_id bigint")) == 30
    W.population(spark.createDataFrame([([3, 1],), ([2],)], "kmers array<bigint>"), f"{tmp_path}/p")
    assert sorted(r["kmers"] for r in W.read_population(spark, f"{tmp_path}/p").collect()) == [[2], [3, 1]]
    (tmp_path / "g.tsv").write_text("4\t1,2\t0.5\t0.25\n")
    assert [tuple(r) for r in W.read_good_individuals(spark, f"{tmp_path}/g.tsv").collect()] == [(4, [1, 2], 0.5, 0.25)]
    log = spark.createDataFrame([("a", 9, {"scoremax": "0.5"}), ("a", 8, {"scoremax": "0.4"}), ("a", 7, {"scoremax": "NA"}), ("a", 6, {"method": "x"})], "run string, gen int, features map<string,string>")
    text = W.run_log(log).first()["value"]
    assert json.loads(text)["run"]["9"] == {"scoremax": "0.5"}
    (tmp_path / "log.json").write_text(text)
    assert sorted((r["gen"], r["features"]["scoremax"]) for r in W.read_run_log(spark, f"{tmp_path}/log.json").collect()) == [(3, "0.4"), (4, "0.5")]
