"""Registry pages, mapping sheet, planning sheet and sinks.

Pages are JSON documents ``{"studies": [...], "nextPageToken": ...}``,
usually gzip-compressed.  A gzip file is not splittable, so one file is one
task and is read once: a page yields its studies' texts, each of which is
parsed with the schema that the mapping sheet declares (``mapping``).  What
does not fit is kept and counted.  ``infer_study`` (a pass over all pages)
is for pages without a typed sheet.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import parse_studies, read_sheet


#: A page whose studies are still JSON texts.
_PAGE = "studies array<string>, nextPageToken string, __bad string"


def page_texts(reader, file_col: str, malformed: str, load) -> DataFrame:
    """(file_col, text, whole) of every study of the pages that ``load`` reads
    with the prepared ``reader``.  A file that is no page stops the job, or,
    with ``malformed="keep"``, is a row of its own whose ``whole`` is its text."""
    if malformed not in ("fail", "keep"):
        raise ValueError(f"malformed: fail or keep, not {malformed}")
    pages = load(reader.schema(_PAGE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad"))
    pages = pages.select(F.col("_metadata.file_path").alias(file_col), "studies", F.col("__bad").alias("whole"))
    if malformed == "fail":
        said = F.raise_error(F.concat(F.lit("malformed page "), F.col(file_col)))
        pages = pages.withColumn("whole", F.when(F.col("whole").isNotNull(), said.cast("string")))
    texts = F.when(F.col("whole").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(
        F.filter("studies", lambda s: s.isNotNull()))
    return pages.select(file_col, F.explode(texts).alias("text"), "whole")


def list_pages(spark: SparkSession, path: str, pattern: str = "*.json*") -> list[str]:
    """Page files under ``path`` in full-path order (file-system metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    it = fs.listFiles(root, True)
    names = []
    glob = jvm.org.apache.hadoop.fs.GlobPattern(pattern)
    while it.hasNext():
        st = it.next()
        name = st.getPath().getName()
        if not name.startswith((".", "_")) and glob.matches(name):  # hidden/metadata files, as Spark skips
            names.append(st.getPath().toString())
    return sorted(names)


def _load(spark: SparkSession, path: str, max_files: int | None):
    def load(reader):
        if max_files is not None:
            return reader.json(list_pages(spark, path)[:max_files])
        return reader.option("pathGlobFilter", "*.json*").option("recursiveFileLookup", "true").json(path)
    return load


def infer_study(spark: SparkSession, path: str, multi_line: bool = True, max_files: int | None = None) -> T.StructType:
    """Type of a study over all pages (one distributed pass)."""
    reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    return _load(spark, path, max_files)(reader).schema["studies"].dataType.elementType


def scan_pages(spark: SparkSession, path: str, study: T.StructType, multi_line: bool = True,
               partitions: int | None = None, file_col: str = "source_file", rest_col: str = "unparsed",
               max_files: int | None = None, malformed: str = "fail") -> DataFrame:
    """Every page file under ``path``, read once; one row per study: the
    source file name, the study's fields and ``rest_col`` (see
    ``mapping.parse_studies``).  ``malformed`` as in ``page_texts``; a kept
    file's text is in ``rest_col``.  ``max_files`` keeps the first files in
    name order (smoke runs)."""
    texts = page_texts(spark.read.option("multiLine", multi_line), file_col, malformed, _load(spark, path, max_files))
    s = parse_pages(texts, study, file_col, rest_col)
    return s.repartition(partitions) if partitions else s


def parse_pages(texts: DataFrame, study: T.StructType, file_col: str, rest_col: str) -> DataFrame:
    s = parse_studies(texts, study, "text", (file_col, "whole"), rest_col)
    return s.withColumn(rest_col, F.coalesce(F.col(rest_col), F.col("whole"))).drop("whole")


def page_counts(scanned: DataFrame, file_col: str = "source_file", rest_col: str = "unparsed") -> DataFrame:
    """Studies of each page file, and those that did not fit the sheet."""
    return scanned.groupBy(file_col).agg(F.count(F.lit(1)).alias("studies"), F.count(rest_col).alias("unparsed"))


def read_mapping(spark: SparkSession, path: str, var_col: str = "variable_wishlist",
                 path_col: str = "ctgov_field") -> dict[str, str]:
    """S3: the sheet's variables and paths (``mapping.read_sheet`` has the types)."""
    return {e.variable: e.path for e in read_sheet(spark, path, var_col=var_col, path_col=path_col)}


def read_planning_sheet(spark: SparkSession, path: str, lead: int | None = None, required: Sequence[str] = (),
                        separator: str = ",") -> DataFrame:
    """S8 (re-aimed): planning sheets exported to CSV.  The header is the line
    after ``lead`` others, or the first line that holds every ``required``
    name; without either it is the first line.  Files may have lead lines of
    different number above the same header; a file without it is an error.
    A row is one line, and empty cells are null."""
    if lead is None and not required:
        return spark.read.option("header", True).option("sep", separator).csv(path)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    cells = F.transform(F.split("line", re.escape(separator)), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    wanted = F.array(*[F.lit(r) for r in required])
    hit = F.col("at") == lead if lead is not None else F.size(F.array_except(wanted, cells)) == 0
    head = F.min_by("line", F.when(hit, F.col("at"))).alias("header")
    # one short row for each file
    heads = lines.groupBy("file").agg(F.when(F.max(hit), head).alias("header"), F.min(F.when(hit, F.col("at"))).alias("top"))
    names = [r.header for r in heads.select("header").distinct().limit(2).collect()]
    if len(names) != 1 or names[0] is None:
        raise ValueError(f"the files of {path} have no header in common: {names}")
    columns = [c.strip() for c in next(csv.reader(names, delimiter=separator))]
    body = lines.join(heads, "file").where((F.col("at") > F.col("top")) & (F.trim("line") != ""))
    schema = ", ".join(f"`{c}` string" for c in columns)
    return body.select(F.from_csv("line", schema, {"sep": separator}).alias("row")).select("row.*")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """S9."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_clustered(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """A Parquet table partitioned by ``by``; each value's rows come
    together first (several files for a value that is too large for a task),
    so it has a few files and not one for every task."""
    df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV (metrics, summaries, importances, per-trial tables)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, digits: int = 6, mode: str = "overwrite") -> None:
    """Records JSON, doubles rounded."""
    cols = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode(mode).json(path)
