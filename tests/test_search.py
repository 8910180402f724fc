"""Operators of the search one by one, and a search that is stopped and goes on."""

import numpy as np
import pytest

from plexmer.plans import search


class Numbers:
    """A pool that hands out 0, 1, 2 and so on."""

    def __init__(self):
        self.next = -1

    def take(self):
        self.next += 1
        return self.next


def test_fresh_individuals_are_new():
    assert search.fresh(Numbers(), 3, {(0, 1, 2), (3, 4, 5)}) == (6, 7, 8)


def test_mutation_hits_each_gene_at_its_rate():
    rng, counts = np.random.default_rng(0), []
    for _ in range(2000):
        pool = Numbers()
        pool.next = 99
        new = search.mutated((1, 2, 3, 4, 5), 0.3, False, pool, {(1, 2, 3, 4, 5)}, rng)
        counts.append(sum(a != b for a, b in zip(new, (1, 2, 3, 4, 5))))
    assert min(counts) == 1 and np.mean(counts) == pytest.approx(1.5 + 0.7**5, abs=0.1)  # an unchanged one changes once
    pool.next = 99
    assert sum(a != b for a, b in zip(search.mutated((1, 2, 3), 0.9, True, pool, set(), rng), (1, 2, 3))) == 1


def test_translocation_takes_a_stretch_and_refills():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = Numbers()
        pool.next = 99
        new = search.translocated((1, 2, 3, 4), (4, 3, 9, 8), pool, set(), rng)
        assert len(set(new)) == 4 and set(new) <= {1, 2, 3, 4, 8, 9} | set(range(100, 110))


def test_noise():
    x = np.c_[np.arange(1000.0), np.ones(1000)]
    out = search.noisy(x, 0.5, np.random.default_rng(0))
    assert (out - x)[:, 0].std() == pytest.approx(0.5 * x[:, 0].std(), rel=0.1) and (out[:, 1] == 1).all() and search.noisy(x, 0.0, None) is x


def test_a_stopped_search_goes_on(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.random(20) + (i == 7) * np.repeat([0, 2], 10)]) for i in range(60)]
    matrix, groups = spark.createDataFrame(rows, "kmer_id bigint, vals array<double>"), ["a"] * 10 + ["b"] * 10
    config = search.Config(individuals=10, generations=4, kmers=3, algorithm="AGA", train_noise=0.1)
    whole = search.run(spark, matrix, groups, config).collect()
    folder = f"file://{tmp_path}/run"
    search.run(spark, matrix, groups, search.replace(config, generations=2), checkpoint=folder).collect()
    assert search.last_state(spark, folder)["generation"] == 1 and search.last_state(spark, folder + "x") is None
    assert search.run(spark, matrix, groups, config, checkpoint=folder).collect() == whole and len(whole) == 4
    # a generation that was not written whole does not count
    (tmp_path / "run" / "generation=00000009").mkdir()
    assert search.run(spark, matrix, groups, config, checkpoint=folder).collect() == whole
