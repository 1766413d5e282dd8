"""ID-list readers.

Each parser takes a DataFrame of text lines (column ``value``, as
``spark.read.text`` gives) so the same code parses files and derived text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import NCT_FULL, py_strip


def read_lines(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Text file(s) -> ``value`` (+ ``pos`` when ordered).

    ``pos`` follows the file names, then the lines of each file: ordered lists
    are small files, so each is read whole and split, and the files (not their
    lines) are ranked.
    """
    if not ordered:
        return spark.read.text(path)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    ranked = files.withColumn("rank", F.row_number().over(Window.orderBy("file")))
    lines = ranked.select("rank", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return lines.select("value", (F.col("rank") * F.lit(1 << 40) + F.col("line")).alias("pos"))


def ids_one_per_line(lines: DataFrame) -> DataFrame:
    """Strip, upper, skip blanks, unique."""
    v = F.upper(py_strip("value"))
    return lines.select(v.alias("id")).where(F.col("id") != "").distinct()


def ids_first_column(lines: DataFrame) -> DataFrame:
    """Whitespace-separated table, first column, unique."""
    first = F.get(F.split(py_strip("value"), r"\s+"), 0)
    return lines.select(F.upper(py_strip(first)).alias("id")).where(F.col("id") != "").distinct()


def ids_ordered(lines: DataFrame, pos_col: str = "pos") -> DataFrame:
    """Ordered list, duplicates keep the first position."""
    v = F.upper(py_strip("value"))
    return (lines.select(v.alias("id"), F.col(pos_col)).where(F.col("id") != "")
            .groupBy("id").agg(F.min(pos_col).alias("pos")))


def ids_tokens(lines: DataFrame, pattern: str = NCT_FULL) -> DataFrame:
    """comma/blank separated tokens that fully match the id pattern."""
    tok = F.explode(F.split(F.col("value"), r"[,\s]+")).alias("t")
    return (lines.select(tok).select(F.upper(py_strip("t")).alias("id"))
            .where(F.col("id").rlike(pattern)).distinct())
