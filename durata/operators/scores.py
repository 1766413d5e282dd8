"""Data-driven 0-100 scores.

* complexity: quantile ranks -> ridge on log(duration) with the penalty
  chosen by contiguous 5-fold CV over 31 log-spaced values -> score =
  sum(rank * beta) (no intercept) -> min-max to 0-100.
* attractiveness: quantile ranks -> first principal component (sign fixed so
  the largest-magnitude loading is positive) -> min-max to 0-100.

The ridge CV needs only per-fold sufficient statistics (sums of x, y, xx',
xy, yy), so one grouped aggregate replaces 31 x 5 separate fits; the tiny
p x p systems are solved on the driver.  PCA is ``pyspark.ml``.  The fitted
state is a few numbers and is stored as JSON.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantile import QuantileUniform, QuantileUniformModel
from .ranks import contiguous_folds
from .reports import scaled_100

# Design columns of the two scores (fixed values of the reference, renamed).
COMPLEXITY_COLS = ["site_n", "country_n", "assessments_n", "elig_crit_n", "num_arms", "patients"]
ATTRACTIVENESS_COLS = ["active_prob", "assessments_n", "elig_crit_n", "novelty_score", "patients", "num_arms"]
RIDGE_ALPHAS = [10 ** (-3 + 6 * i / 30) for i in range(31)]


def weighted_score(df: DataFrame, cols: Sequence[str], beta: Sequence[float], out: str,
                   smin: float | None = None, smax: float | None = None):
    raw = sum((F.col(c) * float(b) for c, b in zip(cols, beta)), F.lit(0.0))
    d = df.withColumn("__raw", raw)
    if smin is None or smax is None:
        smin, smax = d.agg(F.min("__raw"), F.max("__raw")).first()
    d = d.withColumn(out, scaled_100(F.col("__raw"), smin, smax)).drop("__raw")
    return d, smin, smax


@dataclass
class ScoreModel:
    kind: str
    quantiles: QuantileUniformModel
    weights: list[float]
    smin: float
    smax: float
    alpha: float | None = None
    out: str = "score_100"

    def transform(self, df: DataFrame) -> DataFrame:
        u = self.quantiles.transform(df)
        d, _, _ = weighted_score(u, self.quantiles.output_cols, self.weights, self.out, self.smin, self.smax)
        return d.drop(*self.quantiles.output_cols)

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "quantiles": json.loads(self.quantiles.to_json()),
                           "weights": self.weights, "smin": self.smin, "smax": self.smax,
                           "alpha": self.alpha, "out": self.out})

    @classmethod
    def from_json(cls, s: str) -> "ScoreModel":
        d = json.loads(s)
        return cls(d["kind"], QuantileUniformModel.from_json(json.dumps(d["quantiles"])), d["weights"],
                   d["smin"], d["smax"], d.get("alpha"), d.get("out", "score_100"))


def gram_stats(df: DataFrame, feats: Sequence[str], label: str, by: str | None = None) -> dict:
    """Sufficient statistics of a linear model in one aggregate:
    n, sum x, sum y, sum xx', sum xy, sum yy (per group when ``by``)."""
    p = len(feats)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(label).alias("sy"), F.sum(F.col(label) ** 2).alias("syy")]
    aggs += [F.sum(feats[i]).alias(f"sx{i}") for i in range(p)]
    aggs += [F.sum(F.col(feats[i]) * F.col(label)).alias(f"sxy{i}") for i in range(p)]
    aggs += [F.sum(F.col(feats[i]) * F.col(feats[j])).alias(f"sxx{i}_{j}") for i in range(p) for j in range(i, p)]
    rows = (df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)).collect()
    import numpy as np
    out = {}
    for r in rows:
        xx = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                xx[i, j] = xx[j, i] = r[f"sxx{i}_{j}"]
        out[r[by] if by else None] = dict(n=r["n"], sy=r["sy"], syy=r["syy"],
                                          sx=np.array([r[f"sx{i}"] for i in range(p)]),
                                          sxy=np.array([r[f"sxy{i}"] for i in range(p)]), sxx=xx)
    return out


def _add(a, b, sign=1.0):
    return {k: a[k] + sign * b[k] for k in a}


def ridge_solve(st: dict, alpha: float):
    """Ridge with an unpenalised intercept from sufficient statistics."""
    import numpy as np
    n = st["n"]
    mx, my = st["sx"] / n, st["sy"] / n
    cxx = st["sxx"] - n * np.outer(mx, mx)
    cxy = st["sxy"] - n * mx * my
    w = np.linalg.solve(cxx + alpha * np.eye(len(mx)), cxy)
    return w, my - mx @ w


def ridge_r2(st: dict, w, b) -> float:
    """Held-out R^2 of (w, b) on a group given its statistics."""
    n = st["n"]
    sse = (st["syy"] - 2 * b * st["sy"] - 2 * w @ st["sxy"] + n * b * b + 2 * b * w @ st["sx"]
           + w @ st["sxx"] @ w)
    sst = st["syy"] - st["sy"] ** 2 / n
    return 1.0 - sse / sst if sst > 0 else 0.0


def ridge_cv(df: DataFrame, feats: Sequence[str], label: str, fold: str, alphas: Sequence[float]):
    """RidgeCV: mean held-out R^2 per alpha; one Spark pass over the data."""
    per = gram_stats(df, feats, label, by=fold)
    total = None
    for st in per.values():
        total = st if total is None else _add(total, st)
    best, best_r2 = alphas[0], -math.inf
    for a in alphas if len(per) > 1 else ():
        r2 = []
        for st in per.values():
            w, b = ridge_solve(_add(total, st, -1.0), a)
            r2.append(ridge_r2(st, w, b))
        m = sum(r2) / len(r2)
        if m > best_r2:
            best, best_r2 = a, m
    w, b = ridge_solve(total, best)
    return best, [float(x) for x in w], float(b)


def fit_complexity(df: DataFrame, duration: str = "duration_days", cols: Sequence[str] = COMPLEXITY_COLS,
                   id_col: str | None = None, alphas: Sequence[float] = RIDGE_ALPHAS, folds: int = 5,
                   n_quantiles: int = 1000, out: str = "complexity_score_100") -> ScoreModel:
    """M5/M6: ridge weights over quantile ranks, K-fold CV (r2) over
    contiguous blocks of ``id_col``'s order.

    The fit reads its input a few times (medians, knots, fold cuts, one
    statistics pass, min/max): the narrow input projection is persisted."""
    src = df.select(*{*cols, duration, id_col or cols[0]}).persist()
    qt = QuantileUniform(cols, [f"__u{i}" for i in range(len(cols))], n_quantiles=n_quantiles).fit(src)
    u = qt.transform(src).withColumn("__y", F.log(F.col(duration).cast("double")))
    u = u.withColumn("__fold", contiguous_folds(u, id_col or cols[0], folds))
    feats = qt.output_cols
    alpha, beta, _ = ridge_cv(u, feats, "__y", "__fold", alphas)
    _, smin, smax = weighted_score(u, feats, beta, "__s")
    src.unpersist()
    return ScoreModel("complexity", qt, beta, smin, smax, alpha, out)


def fit_attractiveness(df: DataFrame, cols: Sequence[str] = ATTRACTIVENESS_COLS, n_quantiles: int = 1000,
                       out: str = "attractiveness_score_100") -> ScoreModel:
    """M7: first principal component of the centred quantile ranks."""
    src = df.select(*cols).persist()
    qt = QuantileUniform(cols, [f"__u{i}" for i in range(len(cols))], n_quantiles=n_quantiles).fit(src)
    u = qt.transform(src)
    va = VectorAssembler(inputCols=qt.output_cols, outputCol="__f")
    pca = PCA(k=1, inputCol="__f", outputCol="__p").fit(va.transform(u))
    load = [float(x) for x in pca.pc.toArray()[:, 0]]
    j = max(range(len(load)), key=lambda i: abs(load[i]))
    if load[j] < 0:
        load = [-x for x in load]
    _, smin, smax = weighted_score(u, qt.output_cols, load, "__s")
    src.unpersist()
    return ScoreModel("attractiveness", qt, load, smin, smax, None, out)
