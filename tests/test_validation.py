import numpy as np

from plexmer.plans import validation


def test_cross_validation(spark):
    rng = np.random.default_rng(1)
    groups = ["a"] * 12 + ["b"] * 12
    x = rng.random((24, 4))
    x[12:, 0] += 4
    fold = validation.stratified_folds(np.repeat([0, 1], 12), 4, rng)
    assert all((fold[part] == f).sum() == 3 for part in (slice(0, 12), slice(12, 24)) for f in range(4))
    done = validation.cross_validate(spark, x, groups, folds=4, permutations=19, seed=3)
    assert done.count() == 80
    good = validation.summary(done).first()
    assert good["test_mean"] > 0.95 and good["train_mean"] > 0.95 and good["p"] == 1 / 20
    noise = validation.summary(validation.cross_validate(spark, rng.random((24, 4)), groups, folds=4, permutations=19)).first()
    assert noise["p"] > 1 / 20 and noise["test_mean"] < 0.9
    alone = validation.summary(validation.cross_validate(spark, x, groups)).first()
    assert alone["p"] == 1
