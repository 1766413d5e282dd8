"""M4 against a NumPy reading of the quantile transformer; ridge CV from
sufficient statistics against direct NumPy solves; PCA sign rule."""

import numpy as np

from durata.operators import scores
from durata.operators.quantile import QuantileUniform


def np_transform(x, q, refs):
    fwd = np.interp(x, q, refs)
    bwd = -np.interp(-x, -q[::-1], -np.asarray(refs)[::-1])
    y = 0.5 * (fwd + bwd)
    y[x == q[-1]] = 1.0
    y[x == q[0]] = 0.0
    return y


def test_quantile_uniform_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.integers(0, 5, 300), [7, 7, 7, 100]]).astype(float)  # many ties, long tail
    b = rng.normal(size=a.size)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "id long, a double, b double")
    for nq in (5, 50):
        m = QuantileUniform(["a", "b"], ["ua", "ub"], n_quantiles=nq).fit(df)
        refs = np.linspace(0, 1, nq)
        out = sorted((r.id, r.ua, r.ub) for r in m.transform(df).collect())
        for col, j in (("a", 1), ("b", 2)):
            vals = a if col == "a" else b
            q = np.maximum.accumulate(np.percentile(vals, refs * 100))
            want = np_transform(vals, q, refs)
            got = np.array([r[j] for r in out])
            assert np.allclose(got, want, atol=1e-12), (col, nq)


def test_quantile_imputes_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "a double")
    m = QuantileUniform(["a"], ["u"], n_quantiles=5).fit(df)
    assert m.medians == [2.5]


def test_ridge_cv_equals_numpy(spark):
    rng = np.random.default_rng(1)
    n, p = 400, 3
    X = rng.normal(size=(n, p))
    y = X @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(scale=0.3, size=n)
    fold = np.arange(n) * 5 // n
    df = spark.createDataFrame([(int(f), *map(float, x), float(t)) for f, x, t in zip(fold, X, y)],
                               "fold int, x0 double, x1 double, x2 double, y double")
    alphas = [0.01, 1.0, 100.0]
    best, w, b = scores.ridge_cv(df, ["x0", "x1", "x2"], "y", "fold", alphas)

    def fit(Xt, yt, a):
        mx, my = Xt.mean(0), yt.mean()
        Xc = Xt - mx
        wv = np.linalg.solve(Xc.T @ Xc + a * np.eye(p), Xc.T @ (yt - my))
        return wv, my - mx @ wv

    def cv(a):
        r2 = []
        for k in range(5):
            tr, te = fold != k, fold == k
            wv, bv = fit(X[tr], y[tr], a)
            pr = X[te] @ wv + bv
            r2.append(1 - ((y[te] - pr) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
        return np.mean(r2)
    want = max(alphas, key=cv)
    assert best == want
    wv, bv = fit(X, y, want)
    assert np.allclose(w, wv, atol=1e-9) and abs(b - bv) < 1e-9


def test_attractiveness_sign_and_range(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(float(v) for v in rng.normal(size=3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    m = scores.fit_attractiveness(df, cols=["a", "b", "c"], n_quantiles=50)
    j = int(np.argmax(np.abs(m.weights)))
    assert m.weights[j] > 0
    s = [r[0] for r in m.transform(df).select("attractiveness_score_100").collect()]
    assert abs(min(s)) < 1e-9 and abs(max(s) - 100) < 1e-9


def test_medians_and_filled_quantiles_from_one_look_up(spark):
    """Equal to quantiles of the column whose nulls were filled beforehand."""
    import random

    import numpy as np

    from durata.operators.ranks import RankedValues
    rng = random.Random(5)
    cols = {"odd": 21, "even": 20, "one": 1, "none": 0, "full": 40}
    data = {c: [float(rng.randint(-3, 6)) if i < n else None for i in range(40)] for c, n in cols.items()}
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in cols)).repartition(4)
    probs = [i / 19 for i in range(20)]
    medians, filled = RankedValues(df, list(cols), "double").filled_quantiles(probs, 40)
    for c, n in cols.items():
        known = [v for v in data[c] if v is not None]
        m = float(np.median(known)) if n else None
        assert medians[c] == m
        whole = [m or 0.0 if v is None else v for v in data[c]]
        assert np.allclose(filled[c], np.quantile(whole, probs), atol=1e-12)
