"""Small classifiers over samples by chosen features, in numpy: rows are samples, which one task holds.

`fit` gives a model of plain arrays, `predict` its classes.  Models are kept as rows of a table.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("linear", "mlp", "ada", "sgd", "rbf", "neighbours", "fourier", "nystroem")
Model = dict[str, np.ndarray]


def balance(on: np.ndarray) -> np.ndarray:
    """Weights that give both sides of a split the same total."""
    n = len(on)
    return np.where(on, n / (2 * max(1, on.sum())), n / (2 * max(1, n - on.sum())))


def _hinge(design: np.ndarray, on: np.ndarray, penalty: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of the least ``w' penalty w / 2 + balanced squared hinge``, by Newton steps on the samples inside the margin."""
    side, weight, w = np.where(on, 1.0, -1.0), balance(on), np.zeros(design.shape[1])
    for _ in range(steps):
        slack = np.maximum(0, 1 - side * (design @ w))
        active = design * (2 * weight * (slack > 0))[:, None]
        step = np.linalg.solve(penalty + active.T @ design, penalty @ w - active.T @ (side * slack))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _one_vs_rest(design: np.ndarray, y: np.ndarray, classes: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.stack([_hinge(design, y == c, penalty) for c in classes])


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack((x, np.ones(len(x))))


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


def _mlp(x: np.ndarray, y: np.ndarray, classes: np.ndarray, rng: np.random.Generator, hidden: int = 32, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """One hidden layer of rectified units and a softmax, whole-batch Adam."""
    sizes = (x.shape[1], hidden), (hidden,), (hidden, len(classes)), (len(classes),)
    weights = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in sizes]
    first, second, target = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes], y[:, None] == classes
    for t in range(1, steps + 1):
        a, b, c, d = weights
        h = np.maximum(0, x @ a + b)
        z = h @ c + d
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - target) / len(x)
        back = error @ c.T * (h > 0)
        for i, g in enumerate((x.T @ back + decay * a, back.sum(0), h.T @ error + decay * c, error.sum(0))):
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - rate * first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return dict(zip(("a", "b", "c", "d"), weights))


def _stumps(x: np.ndarray, y: np.ndarray, classes: np.ndarray, rounds: int = 50) -> Model:
    """Boosted one-split trees for several classes (SAMME): each gives the heaviest class on both sides of a threshold."""
    n, k, hot = len(x), len(classes), (y[:, None] == classes).astype(float)
    order = np.argsort(x, axis=0, kind="stable")
    values = np.take_along_axis(x, order, 0)
    weight, stumps = np.full(n, 1 / n), []
    for _ in range(rounds):
        mass = np.cumsum((hot * weight[:, None])[order], axis=0)  # below and at each sorted value, by feature and class
        left, right = mass[:-1], mass[-1] - mass[:-1]
        hit = np.where(values[1:] > values[:-1], left.max(2) + right.max(2), -1.0)
        if not hit.size or hit.max() < 0:
            break
        i, feature = np.unravel_index(hit.argmax(), hit.shape)
        error = max(1 - hit[i, feature] / weight.sum(), 1e-10)
        if error >= 1 - 1 / k:
            break
        cut, low, high = (values[i, feature] + values[i + 1, feature]) / 2, left[i, feature].argmax(), right[i, feature].argmax()
        say = np.log((1 - error) / error) + np.log(k - 1)
        stumps.append((feature, cut, low, high, say))
        wrong = np.where(x[:, feature] <= cut, low, high) != hot.argmax(1)
        weight = weight * np.exp(say * wrong)
        weight /= weight.sum()
        if error <= 1e-10:
            break
    return {"stumps": np.array(stumps, float).reshape(-1, 5), "most": np.array([hot.sum(0).argmax()])}


def _sgd(x: np.ndarray, y: np.ndarray, classes: np.ndarray, rng: np.random.Generator, epochs: int = 60, decay: float = 1e-3) -> Model:
    """One-vs-rest hinge by single samples with falling steps; the mean of the second half of the epochs."""
    design, out = _with_one(x), []
    for c in classes:
        on = y == c
        side, weight, w, total, t = np.where(on, 1.0, -1.0), balance(on), np.zeros(design.shape[1]), np.zeros(design.shape[1]), 0
        for epoch in range(epochs):
            for i in rng.permutation(len(design)):
                t += 1
                w = w * (1 - 1 / (t + 10))
                if side[i] * (design[i] @ w) < 1:
                    w = w + side[i] * weight[i] * design[i] / (decay * (t + 10)) * min(1.0, decay * len(design))
            total += w * (2 * epoch >= epochs)
        out.append(total)
    return {"w": np.stack(out)}


def fit(kind: str, x: np.ndarray, y: np.ndarray, seed: int = 0, gamma: float = 0.4, components: int = 100, neighbours: int = 5) -> Model:
    """A model of `kind` (see KINDS) for samples x of classes y."""
    rng, classes = np.random.default_rng(seed), np.unique(y)
    if kind == "linear":
        design = _with_one(x)
        model = {"w": _one_vs_rest(design, y, classes, np.eye(design.shape[1]))}
    elif kind == "mlp":
        model = _mlp(x, y, classes, rng)
    elif kind == "ada":
        model = _stumps(x, y, classes)
    elif kind == "sgd":
        model = _sgd(x, y, classes, rng)
    elif kind == "rbf":
        kernel = _kernel(x, x, gamma) + 1
        model = {"x": x, "w": _one_vs_rest(kernel, y, classes, kernel + 1e-8 * np.eye(len(x))), "gamma": np.array([gamma])}
    elif kind == "neighbours":
        model = {"x": x, "y": np.searchsorted(classes, y), "k": np.array([min(neighbours, len(x))])}
    elif kind == "fourier":
        model = {"waves": rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], components)), "shift": rng.uniform(0, 2 * np.pi, components)}
    elif kind == "nystroem":
        base = x[rng.permutation(len(x))[:components]]
        values, vectors = np.linalg.eigh(_kernel(base, base, gamma))
        model = {"x": base, "map": vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T, "gamma": np.array([gamma])}
    else:
        raise ValueError(f"no such classifier: {kind}")
    if kind in ("fourier", "nystroem"):
        design = _with_one(_features(kind, model, x))
        model["w"] = _one_vs_rest(design, y, classes, np.eye(design.shape[1]))
    return model | {"kind": np.array([kind]), "classes": classes}


def _features(kind: str, model: Model, x: np.ndarray) -> np.ndarray:
    if kind == "fourier":
        return np.sqrt(2 / len(model["shift"])) * np.cos(x @ model["waves"] + model["shift"])
    if kind == "nystroem":
        return _kernel(x, model["x"], model["gamma"][0]) @ model["map"]
    return x


def decide(model: Model, x: np.ndarray) -> np.ndarray:
    """A value for each sample and class; the largest one decides."""
    kind = str(model["kind"][0])
    if kind == "mlp":
        return np.maximum(0, x @ model["a"] + model["b"]) @ model["c"] + model["d"]
    if kind == "ada":
        votes = np.zeros((len(x), len(model["classes"])))
        votes[:, int(model["most"][0])] = 1e-12
        for feature, cut, low, high, say in model["stumps"]:
            votes[np.arange(len(x)), np.where(x[:, int(feature)] <= cut, low, high).astype(int)] += say
        return votes
    if kind == "rbf":
        return (_kernel(x, model["x"], model["gamma"][0]) + 1) @ model["w"].T
    if kind == "neighbours":
        near = np.argsort(((x[:, None] - model["x"]) ** 2).sum(2), axis=1, kind="stable")[:, : int(model["k"][0])]
        return (model["y"][near][:, :, None] == np.arange(len(model["classes"]))).sum(1)
    return _with_one(_features(kind, model, x)) @ model["w"].T


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    return model["classes"][decide(model, x).argmax(axis=1)]


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """A row an array: name, type, shape and values."""
    rows = [(k, str(v.dtype), list(v.shape), json.dumps(v.ravel().tolist())) for k, v in model.items()]
    spark.createDataFrame(rows, "name string, type string, shape array<int>, data string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    return {r["name"]: np.array(json.loads(r["data"]), r["type"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def samples_of(dense: DataFrame, features: list[int]) -> np.ndarray:
    """Samples by the listed features of a dense matrix (kmer_id, vals), in the list's order; 0 where a feature is missing."""
    listed = dense.sparkSession.createDataFrame([(int(f),) for f in features], "kmer_id bigint").distinct()
    rows = {r["kmer_id"]: r["vals"] for r in dense.join(F.broadcast(listed), "kmer_id").collect()}  # a list the caller holds
    n = max((len(v) for v in rows.values()), default=0)
    return np.array([rows.get(f, [0.0] * n) for f in features], float).reshape(len(features), n).T
