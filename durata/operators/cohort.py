"""Projections, cohort filters and schema guards.

Filters are plain predicates on columns, so Catalyst pushes the parts that
rest on source columns into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import _c, py_strip, yes_no


def strip_names(df: DataFrame) -> DataFrame:
    """Strip surrounding blanks from column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def numeric(c) -> "F.Column":
    """Numeric coerce, anything unparsable -> null."""
    return py_strip(_c(c).cast("string")).try_cast("double")


def status_norm(c):
    """P10: trim + upper."""
    return F.upper(py_strip(_c(c).cast("string")))


def cohort_filter(df: DataFrame, start: str, complete: str, as_of: str | _dt.date,
                  start_floor: str | _dt.date = "2000-01-01",
                  status_col: str | None = None, statuses: Sequence[str] = ("COMPLETED", "TERMINATED"),
                  type_col: str | None = None, type_value: str | None = "ACTUAL", normalised: bool = False) -> DataFrame:
    """Start >= floor; completion present and <= as_of; type; status.
    Columns that are ``normalised`` already are compared as they are, so the
    whole filter can reach a scan.

    ``as_of`` is a parameter (the reference used "today"), so runs are
    reproducible.
    """
    text = F.col if normalised else status_norm
    cond = (F.col(start) >= F.lit(str(start_floor)).cast("date")) \
        & F.col(complete).isNotNull() & (F.col(complete) <= F.lit(str(as_of)).cast("date"))
    if type_col is not None:
        cond = cond & (text(type_col) == F.lit(type_value))
    if status_col is not None:
        cond = cond & text(status_col).isin(*statuses)
    return df.where(cond)


def post_filter(df: DataFrame, duration: str = "duration_days", patients: str = "patients",
                min_days: int = 30, max_days: int = 3650, min_patients: float = 10) -> DataFrame:
    """Duration within [min_days, max_days]; patients present and >= min."""
    return df.where(F.col(duration).between(min_days, max_days)
                    & F.col(patients).isNotNull() & (F.col(patients) >= min_patients))


def ensure_columns(df: DataFrame, optional: Mapping[str, str] | Iterable[str],
                   required: Iterable[str] = (), renames: Mapping[str, str] | None = None) -> DataFrame:
    """Rename variants, add absent optional columns as typed nulls,
    fail on absent required columns (one schema check up front)."""
    cols = set(df.columns)
    for src, dst in (renames or {}).items():
        if dst not in cols and src in cols:
            df = df.withColumnRenamed(src, dst)
            cols = set(df.columns)
    missing = [c for c in required if c not in cols]
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    opt = optional.items() if isinstance(optional, Mapping) else ((c, "double") for c in optional)
    for c, t in opt:
        if c not in cols:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df


def select_present(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keep requested columns that exist, report the missing ones."""
    have = [c for c in wanted if c in df.columns]
    return df.select(*have), [c for c in wanted if c not in df.columns]


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    """Columns that start with a prefix, in schema order."""
    return [c for c in df.columns if c.startswith(prefix)]


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """P16."""
    return df.dropna(subset=list(subset))


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant / category fill per column."""
    return df.fillna(dict(values))


def coerce_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """columns with at most two distinct values map 0/1 -> No/Yes.  A
    column qualifies if no value lies strictly between its least and greatest
    (two plain aggregates, no distinct)."""
    if not cols:
        return df
    ends = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    inner = df.agg(*[F.count_if((F.col(c) > F.lit(ends[f"lo_{c}"])) & (F.col(c) < F.lit(ends[f"hi_{c}"]))).alias(c)
                     for c in cols]).first()
    for c in cols:
        if not inner[c]:
            df = df.withColumn(c, yes_no(c))
    return df
