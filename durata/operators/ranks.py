"""Exact ranks and quantiles without a global sort or a whole column in one
buffer.

Values are counted per distinct value (map-side combined), range-partitioned,
and written once to the shared folder, so that every later look sees the same
partitions.  Totals per partition are the only thing the driver adds up; the
rows at wanted positions are then looked up inside their own partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


class RankedValues:
    """The non-null values of one or more columns of one type, in order."""

    def __init__(self, df: DataFrame, cols: Sequence[str], cast: str | None = None):
        def value(c):
            x = F.col(f"`{c}`")
            return x.cast(cast) if cast else x
        pairs = df.select(F.inline(F.array(*[F.struct(F.lit(j).alias("c"), value(c).alias("v"))
                                             for j, c in enumerate(cols)]))).where("v IS NOT NULL")
        counted = pairs.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        self.spark, self.cols = df.sparkSession, list(cols)
        self.rows = cut_lineage(counted.repartitionByRange("c", "v").withColumn("pid", F.spark_partition_id()))
        totals = {(r["c"], r["pid"]): r["n"] for r in
                  self.rows.groupBy("c", "pid").agg(F.sum("n").alias("n")).collect()}
        self.parts = {j: sorted((p, n) for (c, p), n in totals.items() if c == j) for j in range(len(cols))}
        self.count = {c: sum(n for _, n in self.parts[j]) for j, c in enumerate(cols)}

    def at(self, positions: dict[str, Sequence[int]]) -> dict[str, dict[int, object]]:
        """Values at the given positions (from 0) of each column."""
        wanted = []
        for j, c in enumerate(self.cols):
            todo, before = sorted(set(positions.get(c, ()))), 0
            for pid, n in self.parts[j]:
                while todo and todo[0] < before + n:
                    p = todo.pop(0)
                    wanted.append((j, pid, p - before, p))
                before += n
        out: dict[str, dict[int, object]] = {c: {} for c in self.cols}
        if wanted:
            # as many rows as positions were asked for
            targets = F.broadcast(self.spark.createDataFrame(wanted, "c int, pid int, local long, pos long"))
            w = Window.partitionBy("pid", "c").orderBy("v")
            placed = self.rows.withColumn("upto", F.sum("n").over(w))
            hit = placed.join(targets, ["c", "pid"]).where("local >= upto - n AND local < upto")
            for r in hit.select("c", "pos", "v").collect():
                out[self.cols[r["c"]]][r["pos"]] = r["v"]
        return out

    def quantiles(self, probs: Sequence[float]) -> dict[str, list[float] | None]:
        """Linearly interpolated quantiles; None for a column without values."""
        spots = {c: [p * (n - 1) for p in probs] for c, n in self.count.items() if n}
        found = self.at({c: [f(x) for x in xs for f in (math.floor, math.ceil)] for c, xs in spots.items()})

        def between(c, x):
            lo, hi = math.floor(x), math.ceil(x)
            a, b = found[c][lo], found[c][hi]
            return float(a) if lo == hi or a == b else (hi - x) * a + (x - lo) * b
        return {c: [between(c, x) for x in spots[c]] if c in spots else None for c in self.cols}


    def filled_quantiles(self, probs: Sequence[float], rows: int) -> tuple[dict[str, float | None], dict[str, list[float]]]:
        """Medians, and the quantiles of each column once its nulls (up to
        ``rows`` values in all) are filled with its median.  The filled values
        stand together in the middle, so both follow from one look-up; a
        column without values has no median and is 0 throughout."""
        middle = {c: (n + 1) // 2 for c, n in self.count.items()}
        fill = {c: rows - n for c, n in self.count.items()}
        spots = [p * (rows - 1) for p in probs]

        def place(c, p):
            """Position among the values of position ``p`` among all; None: a filled one."""
            return p if p < middle[c] else None if p < middle[c] + fill[c] else p - fill[c]
        some = [c for c, n in self.count.items() if n]
        found = self.at({c: [q for q in (*((n - 1) // 2 for n in [self.count[c]]), self.count[c] // 2, *(
            place(c, f(x)) for x in spots for f in (math.floor, math.ceil))) if q is not None] for c in some})
        medians, filled = {}, {}
        for c in self.cols:
            if c not in some:
                medians[c], filled[c] = None, [0.0] * len(probs)
                continue
            a, b = float(found[c][(self.count[c] - 1) // 2]), float(found[c][self.count[c] // 2])
            medians[c] = a if a == b else 0.5 * a + 0.5 * b

            def value(p, c=c):
                q = place(c, p)
                return medians[c] if q is None else float(found[c][q])

            def between(x):
                lo, hi = math.floor(x), math.ceil(x)
                a, b = value(lo), value(hi)
                return a if lo == hi or a == b else (hi - x) * a + (x - lo) * b
            filled[c] = [between(x) for x in spots]
        return medians, filled


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float] | None]:
    return RankedValues(df, cols, "double").quantiles(probs)


def contiguous_folds(df: DataFrame, order_col: str, folds: int) -> F.Column:
    """Fold number of a row: ``folds`` blocks of ``order_col``'s order, the
    first ``n % folds`` of them one row longer.  Rows with equal values share
    a fold, null values are in fold 0."""
    ranked = RankedValues(df, [order_col])
    n = ranked.count[order_col]
    starts = [k * (n // folds) + min(k, n % folds) for k in range(1, folds)]
    cuts = ranked.at({order_col: [s for s in starts if s < n]})[order_col]
    fold = F.lit(0)
    for v in cuts.values():
        fold = fold + F.coalesce((F.col(order_col) >= F.lit(v)).cast("int"), F.lit(0))
    return fold
