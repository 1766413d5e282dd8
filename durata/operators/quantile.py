"""Median impute + quantile-to-uniform transform (M1 part, M4).

Fit: per column the median (for imputation) and ``n_quantiles`` knots at
evenly spaced probabilities of the imputed values (linear interpolation, i.e.
NumPy's default), exact at every size by counting per distinct value
(``ranks``).  The model is a handful of numbers per column; a column without
any value has the median 0.

Transform (native, no UDF): ``Bucketizer`` binary-searches the distinct
knots, then interpolation runs as column arithmetic on the bucket index.
Semantics follow the usual quantile transformer: values below/above the
knot range clip to 0/1, the first/last knot map to exactly 0/1, and a value
equal to a run of repeated knots maps to the mean of the run's first and
last reference.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import RankedValues


@dataclass
class QuantileUniformModel:
    input_cols: list[str]
    output_cols: list[str]
    medians: list[float]
    knots: list[list[float]]
    references: list[float]
    _prep: list = field(default_factory=list, repr=False)

    # --- per column tables: distinct knots with first/last reference ---
    def _tables(self, j: int):
        q = self.knots[j]
        u, lo, hi = [], [], []
        for i, v in enumerate(q):
            if u and v == u[-1]:
                hi[-1] = self.references[i]
            else:
                u.append(v)
                lo.append(self.references[i])
                hi.append(self.references[i])
        return u, lo, hi

    def transform(self, df: DataFrame, impute: bool = True) -> DataFrame:
        tmp = []
        for j, c in enumerate(self.input_cols):
            x = F.col(c).cast("double")
            if impute:
                x = F.coalesce(x, F.lit(float(self.medians[j])))
            df = df.withColumn(f"__x{j}", x)
            tmp.append(j)
        splits, bcols, outs = [], [], []
        for j in tmp:
            u, _, _ = self._tables(j)
            if len(u) > 2:
                splits.append([float("-inf")] + u[1:-1] + [float("inf")])
                bcols.append(j)
        if bcols:
            bk = Bucketizer(splitsArray=splits, inputCols=[f"__x{j}" for j in bcols],
                            outputCols=[f"__b{j}" for j in bcols], handleInvalid="keep")
            df = bk.transform(df)
        for j, c in enumerate(self.input_cols):
            u, lo, hi = self._tables(j)
            x = F.col(f"__x{j}")
            if len(u) < 2:
                y = F.when(x.isNotNull(), F.lit(0.0))
            else:
                k = F.col(f"__b{j}").cast("int") if j in bcols else F.lit(0)
                U = F.array(*[F.lit(float(v)) for v in u])
                LO = F.array(*[F.lit(float(v)) for v in lo])
                HI = F.array(*[F.lit(float(v)) for v in hi])
                uk, uk1 = F.get(U, k), F.get(U, k + 1)
                inner = F.get(HI, k) + (x - uk) * (F.get(LO, k + 1) - F.get(HI, k)) / (uk1 - uk)
                at_knot = (F.get(LO, k) + F.get(HI, k)) / 2.0
                y = (F.when(x.isNull(), F.lit(None).cast("double"))
                     .when(x <= u[0], F.lit(0.0))
                     .when(x >= u[-1], F.lit(1.0))
                     .when(x == uk, at_knot)
                     .otherwise(inner))
            df = df.withColumn(self.output_cols[j], y)
        drop = [f"__x{j}" for j in range(len(self.input_cols))] + [f"__b{j}" for j in bcols]
        return df.drop(*drop)

    def to_json(self) -> str:
        return json.dumps({"input_cols": self.input_cols, "output_cols": self.output_cols,
                           "medians": self.medians, "knots": self.knots,
                           "references": self.references})

    @classmethod
    def from_json(cls, s: str) -> "QuantileUniformModel":
        d = json.loads(s)
        return cls(d["input_cols"], d["output_cols"], d["medians"], d["knots"], d["references"])


class QuantileUniform:
    def __init__(self, input_cols: Sequence[str], output_cols: Sequence[str] | None = None,
                 n_quantiles: int = 1000):
        self.input_cols = list(input_cols)
        self.output_cols = list(output_cols or [f"{c}_q" for c in input_cols])
        self.n_quantiles = n_quantiles

    def fit(self, df: DataFrame) -> QuantileUniformModel:
        ranked = RankedValues(df, self.input_cols, "double")
        rows = df.count()
        nq = max(1, min(self.n_quantiles, rows))
        refs = [i / (nq - 1) for i in range(nq)] if nq > 1 else [0.0]
        halves, row = ranked.filled_quantiles(refs, rows)
        medians = [halves[c] or 0.0 for c in self.input_cols]
        knots = []
        for c in self.input_cols:
            k = row[c]
            for i in range(1, len(k)):  # monotone, as the reference transformer enforces
                k[i] = max(k[i], k[i - 1])
            knots.append(k)
        return QuantileUniformModel(self.input_cols, self.output_cols,
                                    [float(m) for m in medians], knots, refs)
