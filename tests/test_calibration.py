import numpy as np

from skysieve.operators.learning import _fit_calibrator


def test_sigmoid_targets_are_smoothed(spark):
    """On separable scores plain labels have no finite optimum; smoothed ones have one, found here by Newton steps."""
    rng = np.random.default_rng(0)
    s = np.concatenate([rng.uniform(0, 0.4, 60), rng.uniform(0.6, 1, 20)])
    y = (s > 0.5).astype(int)
    t = np.where(y == 1, 21 / 22, 1 / 62)
    w, x = np.zeros(2), np.stack([s, np.ones_like(s)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (t - p))
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "_s double, y int")
    got = _fit_calibrator(rows, "sigmoid")
    assert np.allclose([got.coefficients[0], got.intercept], w, rtol=1e-3)
