"""Classifiers, their comparison, embeddings and clusterings on data whose answer is known."""

import numpy as np
import pytest

from plexmer.operators import classifiers, clustering, manifold
from plexmer.plans import comparison


def blobs(n=40, dims=4, k=3, apart=6.0, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.eye(k, dims) * apart
    y = np.repeat(np.arange(k), n)
    return centres[y] + rng.normal(0, 0.5, (n * k, dims)), y


@pytest.mark.parametrize("kind", classifiers.KINDS)
def test_classifiers(kind):
    x, y = blobs()
    names = np.array(["a", "b", "c"])[y]
    model = classifiers.fit(kind, x[::2], names[::2], gamma=0.1)
    assert (classifiers.predict(model, x[1::2]) == names[1::2]).mean() > 0.95
    two = classifiers.fit(kind, x[y < 2], names[y < 2], gamma=0.1)
    assert set(classifiers.predict(two, x)) <= {"a", "b"}


def test_curved_borders_need_kernels():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 2))
    y = (np.linalg.norm(x, axis=1) > 1.1).astype(int)
    right = {k: (classifiers.predict(classifiers.fit(k, x[:200], y[:200]), x[200:]) == y[200:]).mean() for k in classifiers.KINDS}
    assert right["linear"] < 0.75 and all(right[k] > 0.85 for k in ("rbf", "mlp", "ada", "nystroem", "neighbours", "fourier")), right


def test_models_are_kept(spark, tmp_path):
    x, y = blobs()
    for kind in classifiers.KINDS:
        model = classifiers.fit(kind, x, np.array(["a", "b", "c"])[y])
        classifiers.save_model(spark, model, f"{tmp_path}/{kind}")
        again = classifiers.load_model(spark, f"{tmp_path}/{kind}")
        assert (classifiers.predict(again, x) == classifiers.predict(model, x)).all() and set(again) == set(model)


def test_comparison(spark):
    x, y = blobs(n=15, dims=5)
    names = [["a", "b", "c"][i] for i in y]
    names[0] = "b"  # one sample is mislabelled
    kinds = ("linear", "neighbours")
    rows = comparison.predictions(spark, x, names, kinds).persist()
    assert rows.count() == 2 * 45 and rows.select("kind", "sample").distinct().count() == 90
    for r in comparison.report(rows).collect():
        assert r["parts"] == 5 and r["test"] > 0.9
    worst = comparison.sample_report(rows).orderBy("false_rate", ascending=False).first()
    assert (worst["sample"], worst["tested"], worst["right"], worst["false_rate"], worst["guesses"]) == (0, 1, 0, 1.0, ["a"]) and worst["gain"] < 0
    assert comparison.eliminate(spark, x, names, "neighbours", turns=12) == [0]


@pytest.mark.parametrize("method", manifold.METHODS)
def test_embeddings_keep_groups_apart(method):
    x, y = blobs(n=30, dims=6, k=3, apart=4.0 if method != "ltsa" else 1.5)
    low = manifold.embed(method, x, 2, 40 if method in ("lle", "ltsa", "isomap", "spectral") else 10)
    assert low.shape == (90, 2) and np.isfinite(low).all()
    if method != "ltsa":
        near = manifold.neighbours(low, 5)
        assert (y[near] == y[:, None]).mean() > 0.9
    assert manifold.embed(method, x[:2]).shape == (2, 2)


def test_curves_are_unrolled():
    t = np.linspace(0, 3 * np.pi, 150)
    x = np.column_stack((t * np.cos(t), t * np.sin(t)))
    length = np.concatenate(([0], np.cumsum(np.linalg.norm(np.diff(x, axis=0), axis=1))))
    for method in ("isomap", "lle", "ltsa"):
        assert abs(np.corrcoef(manifold.embed(method, x, 1, 6)[:, 0], length)[0, 1]) > (0.99 if method == "isomap" else 0.9)
    d = manifold.distances(np.random.default_rng(0).normal(0, 1, (30, 2)))
    assert manifold.distances(manifold.classical(d, 2)) == pytest.approx(d, abs=1e-6) and manifold.distances(manifold.stress(d, 2)) == pytest.approx(d, abs=1e-4)
    parts = np.concatenate((np.arange(5.0), np.arange(100.0, 105)))[:, None]
    assert manifold.geodesic(parts, 2)[0, 9] == pytest.approx(104)


@pytest.mark.parametrize("method", clustering.METHODS)
def test_clusterings(method):
    x, y = blobs(n=30, dims=3, k=3)
    labels = clustering.cluster(method, x, 3, radius=1.0 if method == "birch" else 2.0)
    assert len(labels) == 90 and labels[0] == 0
    assert all(len(set(labels[y == c])) == 1 for c in range(3)) and len(set(labels)) == 3
    assert clustering.cluster(method, x[:1], 3).tolist() == [0] and len(clustering.cluster(method, x[:0], 3)) == 0
    assert len(clustering.cluster(method, np.ones((6, 2)), 2)) == 6


def test_clusters_of_runs(spark):
    rows = spark.createDataFrame([("r1", 0, [1, 2]), ("r2", 0, [2, 3]), ("r2", 1, [9])], "run string, cluster int, kmers array<bigint>")
    assert [tuple(r) for r in clustering.cluster_features(rows).orderBy("cluster").collect()] == [(0, 2, 2, [1, 2, 3]), (1, 1, 1, [9])]
    assert tuple(clustering.mean_runs(rows).first()) == (2, 1.5) and len(clustering.sweep(np.eye(4), (2, 3), ("ward", "kmeans"))) == 4
