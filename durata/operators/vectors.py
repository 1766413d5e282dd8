"""Vector tables: left join on normalised ids, coverage, expansion (J1, A13, T6x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def vector_left_join(base: DataFrame, base_id: str, vecs: DataFrame, vec_id: str, vec_col: str) -> DataFrame:
    """Left join on normalised ids (m:n allowed; null ids never match)."""
    b = base.withColumn("__nid", R.normalise_id(base_id))
    v = vecs.select(R.normalise_id(vec_id).alias("__nid"), F.col(vec_col))
    return b.join(v, "__nid", "left").drop("__nid")


def missing_vector(vec_col: str) -> Column:
    """A13 (row-wise): vector absent or holding a null."""
    v = F.col(vec_col)
    return (v.isNull() | F.exists(v, lambda x: x.isNull())).cast("long")


def coverage(df: DataFrame, vec_col: str) -> DataFrame:
    """A13 (report): rows, rows missing a vector."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(missing_vector(vec_col)).alias("rows_missing"))


def expand_columns(vec_col: str, dims: int, prefix: str, digits: int | None = None) -> list[Column]:
    """T6x: one column per dimension."""
    out = []
    for i in range(dims):
        c = F.get(F.col(vec_col), i).cast("double")
        out.append((F.round(c, digits) if digits is not None else c).alias(f"{prefix}{i:03d}"))
    return out
