import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexmer.operators import cuts, evaluation, history, reports, trimming
from plexmer.plans import search

OCC = "run string, kmer_id bigint, nview bigint"


def test_quality_and_adapters(spark):
    rng = random.Random(1)
    for _ in range(100):
        qual = [rng.randint(2, 40) for _ in range(rng.randint(0, 30))]
        total, best, end = 0, 0, len(qual)
        for i in range(len(qual) - 1, -1, -1):
            total += 20 - qual[i]
            if total < 0:
                break
            if total > best:
                best, end = total, i
        assert trimming.quality_end("".join(chr(q + 33) for q in qual)) == end
    adapter = trimming.ADAPTERS["illumina"]
    assert trimming.adapter_start("CCCCCCCC" + adapter + "TT", adapter) == 8 and trimming.adapter_start("CCCCC" + adapter[:6], adapter) == 5
    assert trimming.adapter_start("CCCCCCCC" + adapter.replace("C", "T", 1), adapter) == 8 and trimming.adapter_start("CCCC", adapter) == 4 and trimming.adapter_start("", adapter) == 0
    reads = spark.createDataFrame([(1, "CCCCCC" + adapter, "I" * 19), (2, "TTTTTTTT", "IIII!!!!"), (3, None, None), (4, "", "")], "read_ix int, seq string, qual string")
    assert trimming.detect_adapter(reads) == "illumina" and trimming.detect_adapter(reads.limit(0)) == "illumina"
    got = {r["read_ix"]: (r["seq"], r["qual"]) for r in trimming.trim(reads, adapter).collect()}
    assert got == {1: ("CCCCCC", "I" * 6), 2: ("TTTT", "IIII"), 3: ("", ""), 4: ("", "")}
    assert {r["seq"] for r in trimming.trim(reads, adapter, clip5=1, clip3=2).collect()} == {"CCC", "T", ""}
    mates = spark.createDataFrame([(1, 1, "A" * 30), (1, 2, "A" * 5), (2, 1, "A" * 30), (2, 2, "A" * 20)], "pair int, mate int, seq string")
    assert trimming.long_enough(mates).count() == 3 and {r["pair"] for r in trimming.long_enough(mates, by=["pair"]).collect()} == {2}
    assert [tuple(r) for r in trimming.position_quality(reads.where("read_ix = 2")).orderBy("pos").collect()][::4] == [(0, 40.0, 1), (4, 0.0, 1)]


def test_cuts(spark):
    rng = np.random.default_rng(2)
    views = np.sort(np.r_[rng.integers(1, 8, 5000), rng.integers(8, 400, 300)])[::-1]
    occ = spark.createDataFrame([("r", i, int(v)) for i, v in enumerate(views)], OCC)
    bins, edges = np.histogram(views, np.arange(1, views.max() + 1))
    drops = np.diff(bins)
    start = edges[1:-1][np.argmax(drops > drops.min() * 0.005)]
    assert cuts.winner_cut(occ).count() == (views >= start).sum()
    means = views[: len(views) // 10 * 10].reshape(-1, 10).mean(axis=1)
    slopes = np.diff(means)
    assert cuts.slope_cut(occ).count() == 10 * int(np.argmax(cuts.smooth(slopes) > slopes.min() * 0.01)) > 0
    for f in (cuts.winner_cut, cuts.slope_cut, cuts.view_bins):
        assert f(occ.limit(0)).count() == 0 and f(occ.limit(1)).count() <= 1
    assert cuts.smooth(np.ones(30)) == pytest.approx(np.ones(39)) and len(cuts.smooth(np.ones(3))) == 3
    flat = spark.createDataFrame([(1, [2.0, 2.0, 2.0]), (2, [0.0, 1.0, 5.0])], "kmer_id bigint, vals array<double>")
    assert [(r["kmer_id"], r["ratio"]) for r in cuts.variability(flat).collect()] == [(2, pytest.approx(2 / 7))]
    samples = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a")], "ord int, grp string")
    got = {(r["kmer_id"], r["ord"]): r["spread"] for r in cuts.group_spread(flat, samples).collect()}
    assert got[1, 0] == 0 and got[2, 2] == 4 and got[2, 0] == -1


def test_history(spark):
    rng = random.Random(4)
    rows = [("r", i, rng.sample(range(12), 3), rng.random()) for i in range(1, 61)]
    ind = spark.createDataFrame(rows, "run string, iter bigint, kmers array<bigint>, score double")

    def head(last):
        n = {k: sum(k in r[2] for r in rows if r[1] <= last) for k in range(12)}
        return set(sorted((k for k in n if n[k]), key=lambda k: (-n[k], k))[:5])

    got = {r["iter"]: r["distance"] for r in history.head_distances(ind, 7, 5).collect()}
    assert got == {b: len(head(60) - head(b)) for b in range(7, 61, 7)}
    steady = spark.createDataFrame([(10, 5), (20, 1), (30, 1), (40, 1)], "iter bigint, distance bigint")
    assert history.converged(steady) and not history.converged(steady.where("iter <= 30")) and not history.converged(steady.limit(0))
    assert history.head_distances(ind.limit(0), 7, 5).count() == 0
    a, b = (spark.createDataFrame(x, "kmer_id bigint, pos int") for x in ([(5, 0), (6, 1)], [(6, 0), (7, 1)]))
    assert sorted(map(tuple, history.ordered_union(a, b).collect())) == [(5, 0, 0), (6, 0, 1), (7, 1, 1)]
    row = spark.range(1).select(history.set_similarity(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3), F.lit(4))).alias("s"), history.mean_score(F.lit(0.9), F.lit(0.6)).alias("m")).first()
    assert row["s"] == pytest.approx(1 / 3) and row["m"] == pytest.approx(0.8)


def _most_rows(spark, run):
    """Rows out of the largest step of any plan that `run` executes."""
    items = lambda seq: [seq.apply(i) for i in range(seq.size())]
    store = spark._jsparkSession.sharedState().statusStore()
    before = {x.executionId() for x in items(store.executionsList())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = [0]
    for i in {x.executionId() for x in items(store.executionsList())} - before:
        values = store.executionMetrics(i)
        for node in items(store.planGraph(i).allNodes().toSeq()):
            for m in items(node.metrics().toSeq()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    found.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(found)


def _lists(rows, step, top):
    """The head list at each bound and at the end, counted plainly."""
    def at(last):
        n = collections.Counter(k for _, i, kmers, _ in rows for k in kmers if last is None or (i is not None and i <= last))
        return set(sorted(n, key=lambda k: (-n[k], k))[:top])

    most = max(i for _, i, *_ in rows if i is not None)
    return {b: at(b) for b in range(step, most + 1, step)}, at(None)


def test_head_lists_with_gaps_and_odd_iterations(spark):
    rng = random.Random(9)
    at = [-3, 0, None, None, *(i for i in range(1, 400) if not 120 < i < 260)]
    rows = [(rng.choice("ab"), i, rng.sample(range(max(0, (i or 0) // 9 - 12), (i or 0) // 9 + 9), 4), 0.5) for i in at]
    ind = spark.createDataFrame(rows, "run string, iter bigint, kmers array<bigint>, score double")
    lists, end = _lists(rows, 5, 6)
    assert {r["iter"]: r["distance"] for r in history.head_distances(ind, 5, 6).collect()} == {b: len(end - x) for b, x in lists.items()}
    assert history.head_distances(ind.where("iter IS NULL OR iter < 5"), 5, 6).count() == 0
    want = {}
    for run in "ab":
        lists, end = _lists([r for r in rows if r[0] == run], 5, 6)
        want[run] = next(b for b, x in [*lists.items(), (400, end)] if len(x & end) >= 2)
    assert {r["run"]: r["bound"] for r in reports.settled(ind, 5, 6, 2).collect()} == want


def test_head_lists_hold_no_row_for_each_kmer_and_bound(spark):
    rows = [("r", i, [i, i + 1], 0.5) for i in range(1, 2001)]
    ind = spark.createDataFrame(rows, "run string, iter bigint, kmers array<bigint>, score double")
    for run in (lambda: history.head_distances(ind, 1, 5).collect(), lambda: reports.settled(ind, 1, 5, 2).collect()):
        assert 4_000 <= _most_rows(spark, run) < 100_000  # of 2,000 k-mers and 2,000 bounds


def test_evaluation(spark):
    vals = {0: [0.0, 1.0], 1: [0.0, 2.0], 2: [9.0, 9.0], 3: [9.0, 8.0], 4: [0.0, 0.0]}
    m = spark.createDataFrame([(k, o, v) for o, x in vals.items() for k, v in enumerate(x) if v], "kmer_id bigint, ord int, val double")
    s = spark.createDataFrame([(o, "far" if o in (2, 3) else "near") for o in vals], "ord int, grp string")
    d = evaluation.sample_distances(m, s)
    assert {(r["ord1"], r["ord2"]): r["distance"] for r in d.collect()} == {(a, b): pytest.approx(math.dist(vals[a], vals[b])) for a in vals for b in vals if a != b}
    votes = evaluation.nearest_vote(d, s, 1)
    assert all(r["grp"] == r["predicted"] for r in votes.collect()) and {r["percent"] for r in evaluation.confusion(votes).collect()} == {100.0}
    assert min(r["silhouette"] for r in evaluation.silhouette(d, s).collect()) > 0.8
    scored = spark.createDataFrame([("c", 0.9, 1), ("c", 0.8, 0), ("c", 0.7, 1), ("c", 0.1, 0)], "cls string, score double, label int")
    assert evaluation.average_precision(scored).first()["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    points = spark.createDataFrame([(x, g["grp"]) for (o, x), g in zip(sorted(vals.items()), s.orderBy("ord").collect())], "vals array<double>, grp string")
    assert evaluation.calinski_harabasz(points).first()[0] > 100
    rows, share = evaluation.components(points, 2)
    assert share[0] > 0.95 and sum(share) == pytest.approx(1) and rows.count() == 5


def test_rates_and_grid():
    scores = np.array([0.2, 0.4, 0.6, 0.8])
    of = lambda kind, x: search.rate(kind, x, scores, (0.3, 0.2, 0.1), (0.8, 0.4, 1.0))
    assert of("GA", 0.8) == 0.3 and of("AGA", 0.2) == 0.3 and of("AGA", 0.8) == pytest.approx(0)
    assert [of("IAGA", x) for x in (0.2, 0.5, 0.8)] == pytest.approx([0.3, 0.2, 0.1])
    assert of("IAGA_Ravindran", 0.2) == 0.8 and of("IAGA_Ravindran", 0.8) == pytest.approx(0.4 / (1 + math.e))
    assert search.rate("IAGA", 0.5, np.full(4, 0.5), (0.3, 0.2, 0.1), (1, 0, 1)) == 0.2
    with pytest.raises(ValueError):
        of("other", 0.5)
    rng = np.random.default_rng(0)
    assert np.mean([search.mate(scores, 4, rng) for _ in range(500)]) > 2.3 and {search.mate(scores, 0, rng) for _ in range(200)} == {0, 1, 2, 3}
    assert [(c.kmers, c.algorithm) for c in search.grid(kmers=[2, 3], algorithm=["GA", "IAGA"])] == [(2, "GA"), (2, "IAGA"), (3, "GA"), (3, "IAGA")]


def test_search_restarts(spark):
    rng = np.random.default_rng(5)
    m = spark.createDataFrame([(i, rng.random(12).tolist()) for i in range(20)], "kmer_id bigint, vals array<double>")
    config = search.Config(individuals=8, generations=3, kmers=3, algorithm="IAGA", tournament=2, elite=3, kill_elite_every=2, one_gene_mutation=True, test_rate=0.4)
    args = (spark, m, ["a"] * 6 + ["b"] * 6, config, [(1, 2, 3)])
    history = search.run(*args, outer=np.r_[-1, [0] * 5, -1, [0] * 5], keep=list(range(10))).collect()
    assert len(history) == 3 and all(max(r["kmers"]) < 10 for r in history)
    assert history == search.run(*args, outer=np.r_[-1, [0] * 5, -1, [0] * 5], keep=list(range(10))).collect()


def test_registered_search_has_the_default_size(spark, monkeypatch):
    from plexmer import queries
    from plexmer.plans import search

    seen = []
    monkeypatch.setattr(queries.search, "run", lambda *a: seen.append(a[-1]))
    queries.QUERIES["feature_search"](spark, "/root/testdata/sf0.001")
    assert seen == [search.Config()]
