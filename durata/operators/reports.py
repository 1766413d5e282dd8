"""Aggregations and reports.

Most are single-pass ``agg`` calls (partial aggregation before the shuffle);
none collects rows to the driver.  Percentiles of ``describe`` and
``box_stats`` are exact at every size, by counting per distinct value
(``ranks``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.rules import DAYS_PER_YEAR, day_diff, parse_date_any
from .ranks import exact_quantiles

DESCRIBE_PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _pct_name(p: float) -> str:
    return f"p{int(round(p * 100)):02d}"


def error_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (),
                  scale: float = 1.0) -> DataFrame:
    """A5: n, MAE, RMSE, R^2 in one pass (R^2 = 1 - SSE / (n var_pop(y)))."""
    e = F.col(pred) - F.col(truth)
    aggs = [F.count(F.lit(1)).alias("n"),
            (F.avg(F.abs(e)) / scale).alias("mae"),
            (F.sqrt(F.avg(e * e)) / scale).alias("rmse"),
            (F.lit(1.0) - F.sum(e * e) / (F.var_pop(truth) * F.count(F.lit(1)))).alias("r2")]
    return df.groupBy(*by).agg(*aggs)


def seed_summary(metrics: DataFrame, by: Sequence[str], mae: str = "mae", rmse: str = "rmse",
                 r2: str = "r2", flag: str | None = None) -> DataFrame:
    """A1/A4: mean and sample std of MAE over seeds, mean RMSE and R^2."""
    aggs = [F.count(F.lit(1)).alias("n_seeds"),
            F.avg(mae).alias("mae_mean"), F.stddev_samp(mae).alias("mae_std"),
            F.avg(rmse).alias("rmse_mean"), F.avg(r2).alias("r2_mean")]
    if flag:
        aggs.append(F.max(flag).alias(flag))
    return metrics.groupBy(*by).agg(*aggs)


def per_entity_stats(preds: DataFrame, id_col: str, err: str, truth: str | None = None,
                     pred: str | None = None, std_single: float | None = 0.0,
                     days_per_year: float = DAYS_PER_YEAR) -> DataFrame:
    """A2/A3: per id mean/std/n of the error over runs (std of one run -> 0)."""
    def sd(c):
        s = F.stddev_samp(c)
        return s if std_single is None else F.coalesce(s, F.lit(float(std_single)))
    aggs = [F.count(F.lit(1)).alias("n_runs"), F.avg(err).alias("err_mean"), sd(err).alias("err_std")]
    if truth:
        aggs.append(F.avg(truth).alias("truth_mean"))
    if pred:
        aggs += [F.avg(pred).alias("pred_mean"), sd(pred).alias("pred_std")]
    out = preds.groupBy(id_col).agg(*aggs)
    return (out.withColumn("err_mean_years", F.col("err_mean") / days_per_year)
               .withColumn("err_std_years", F.col("err_std") / days_per_year))


def describe(df: DataFrame, col: str, ps: Sequence[float] = DESCRIBE_PERCENTILES) -> DataFrame:
    """Count, mean, std, min, percentiles, max of one column."""
    q = exact_quantiles(df, [col], ps)[col] or [None] * len(ps)
    r = df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"),
               F.stddev_samp(col).alias("std"), F.min(col).alias("min"),
               F.max(col).alias("max"))
    return r.select("count", "mean", "std", "min",
                    *[F.lit(q[i]).cast("double").alias(_pct_name(p)) for i, p in enumerate(ps)], "max")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max; the maximum folds into the
    last bin.  Returns (bin, lo, hi, n) for non-empty bins."""
    rng = df.agg(F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    mn, mx = rng.first()
    width = (mx - mn) / bins if mx is not None and mx != mn else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(mn)) * bins / F.lit((mx - mn) or 1.0)) + 1, F.lit(bins))
    out = (df.where(F.col(col).isNotNull()).groupBy(b.cast("long").alias("bin"))
           .agg(F.count(F.lit(1)).alias("n")))
    return out.select("bin", (F.lit(mn) + (F.col("bin") - 1) * width).alias("lo"),
                      (F.lit(mn) + F.col("bin") * width).alias("hi"), "n")


def box_stats(df: DataFrame, col: str) -> DataFrame:
    """Quartiles, IQR, 1.5 IQR whiskers (most extreme points inside),
    outlier count."""
    q1, med, q3 = exact_quantiles(df, [col], (0.25, 0.5, 0.75))[col] or (0.0, 0.0, 0.0)
    iqr = q3 - q1
    lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    x = F.col(col)
    inside = (x >= lo) & (x <= hi)
    return df.agg(F.lit(q1).alias("q1"), F.lit(med).alias("median"), F.lit(q3).alias("q3"),
                  F.lit(iqr).alias("iqr"),
                  F.min(F.when(inside, x)).alias("whisker_lo"),
                  F.max(F.when(inside, x)).alias("whisker_hi"),
                  F.count(F.when(~inside, x)).alias("n_outliers"))


def profile(df: DataFrame) -> DataFrame:
    """A10: per column dtype, non-null and null counts (one aggregate)."""
    aggs = []
    for c in df.columns:
        aggs += [F.count(F.col(f"`{c}`")).alias(f"nn__{c}")]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    dtypes = dict(df.dtypes)
    stack = ", ".join(f"'{c}', '{dtypes[c]}', `nn__{c}`" for c in df.columns)
    return row.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, dtype, non_null)",
                          "__rows").select("column_name", "dtype", F.col("non_null").cast("long"),
                                           (F.col("__rows") - F.col("non_null")).cast("long").alias("nulls"))


def profile_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A10, describe part: per numeric column count, mean, std, min, quartiles
    and max, one row each."""
    kinds = dict(df.dtypes)
    cols = [c for c in (cols or df.columns)
            if kinds[c] in ("int", "bigint", "smallint", "tinyint", "float", "double") or kinds[c].startswith("decimal")]
    q = exact_quantiles(df, cols, (0.25, 0.5, 0.75)) if cols else {}
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.struct(F.lit(c).alias("column_name"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                          F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                          *[F.lit((q[c] or [None] * 3)[i]).cast("double").alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
                          F.max(x).alias("max")).alias(f"__{c}")]
    if not aggs:
        raise ValueError("no numeric column")
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"`__{c}`") for c in cols])))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A11."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """TakeOrderedAndProject; ``order`` must end in a unique key."""
    return df.orderBy(*order).limit(k)


def scaled_100(x: Column, smin: float | None, smax: float | None) -> Column:
    """100 (x - min) / (max - min); 0 where min and max are equal."""
    if smin is None or smax is None or smin == smax:
        return F.when(x.isNotNull(), F.lit(0.0))
    return F.lit(100.0) * (x - F.lit(smin)) / F.lit(smax - smin)


def minmax_scale(df: DataFrame, col: str, out: str, smin: float | None = None,
                 smax: float | None = None) -> tuple[DataFrame, float, float]:
    """100 (x - Smin) / (Smax - Smin); Smin/Smax fitted when not given."""
    if smin is None or smax is None:
        smin, smax = df.agg(F.min(col), F.max(col)).first()
    return df.withColumn(out, scaled_100(F.col(col), smin, smax)), smin, smax


def concat_blocks(blocks: Sequence[tuple[str, DataFrame]], label_col: str = "block") -> DataFrame:
    """Row concatenation of result frames with a block label."""
    out = None
    for name, df in blocks:
        d = df.withColumn(label_col, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def sort_summary(summary: DataFrame, metric: str = "mae_mean", baseline_flag: str | None = None,
                 group: str | None = None, position: str | None = None) -> DataFrame:
    """Baseline rows first (per group), then the metric descending;
    ``position`` names a column for the place (summaries are small)."""
    order = []
    if group:
        order.append(F.col(group))
    if baseline_flag:
        order.append(F.col(baseline_flag).desc())
    order.append(F.col(metric).desc())
    if position:
        summary = summary.withColumn(position, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return summary.orderBy(*order)


SCORES = ("complexity_score_100", "attractiveness_score_100")


def _build_aggregates(df: DataFrame, duration: str, category: str, scores: Sequence[str], kinds) -> list:
    aggs = [F.count(F.lit(1)).alias("rows"), F.count(duration).alias("durations_non_null"),
            F.min(duration).alias("duration_min"), F.max(duration).alias("duration_max"),
            kinds(category).alias(f"{category}_distinct")]
    for s in scores:
        if s in df.columns:
            aggs += [F.min(s).alias(f"{s}_min"), F.max(s).alias(f"{s}_max")]
    return aggs


def build_report(df: DataFrame, duration: str = "duration_days", category: str = "phase",
                 scores: Sequence[str] = SCORES) -> DataFrame:
    """Rows, non-null durations, min/max duration, distinct categories,
    score ranges -- one aggregate."""
    return df.agg(*_build_aggregates(df, duration, category, scores, F.count_distinct))


def observed_build(df: DataFrame, duration: str = "duration_days", category: str = "phase",
                   scores: Sequence[str] = SCORES) -> tuple[DataFrame, Observation]:
    """A12 without a pass of its own: ``df``, and the report's numbers, which
    the first action on it (the write) leaves in the observation.  ``category``
    must have few values, as the phase labels do: they are held as a set."""
    seen = Observation(f"build-{uuid.uuid4().hex}")
    aggs = _build_aggregates(df, duration, category, scores, lambda c: F.size(F.collect_set(c)).cast("long"))
    return df.observe(seen, *aggs), seen


def planned_vs_actual(df: DataFrame, planned_start: str, planned_end: str, actual_start: str, actual_end: str,
                      days_per_year: float = 365.0) -> DataFrame:
    """lenient dates, planned and actual durations, signed delta and the
    absolute error in years; rows missing either duration are dropped."""
    d = df.withColumn("manual_days", day_diff(parse_date_any(planned_end), parse_date_any(planned_start))) \
          .withColumn("actual_days", day_diff(parse_date_any(actual_end), parse_date_any(actual_start)))
    d = d.dropna(subset=["manual_days", "actual_days"])
    d = d.withColumn("delta_days", F.col("actual_days") - F.col("manual_days"))
    return d.withColumn("abs_error_years", F.abs("delta_days") / days_per_year)


def expert_error(df: DataFrame, scope: str, days_per_year: float = 365.0) -> DataFrame:
    """Rows, mean absolute and mean signed error in years."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg("abs_error_years").alias("mae_years"),
                  F.avg(F.col("delta_days") / days_per_year).alias("signed_years")) \
        .select(F.lit(scope).alias("scope"), "n", "mae_years", "signed_years")
