"""Corpus pipeline: quality rules, line de-duplication, near-duplicate
removal, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` writes
each result as Parquet in the shared folder and reads it back for the next.
The stages call the operators of ``durata.llm`` with their production
parameters; chunk hashes, frequency order and BPE are beyond SQL, so there is
no ORACLE_SQL and tests compare the stages with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from durata.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules, shared

ORACLE_SQL = None
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision verdict keeps.  The measures are
    taken twice, to learn and to filter, so no text is shuffled or staged."""
    model = quality_rules.learn(quality_rules.with_votes(quality_rules.measures(docs)))
    voted = quality_rules.with_votes(quality_rules.measures(docs, keep=tuple(docs.columns)))
    return quality_rules.judge(voted, model).filter("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without globally repeated chunks of lines; ``n_chars``
    follows the text."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a written number of its own for every row, under a name
    that no column has: verdicts are on rows, whatever doc_id they repeat or lack."""
    key = next(k for k in (f"row_{i}" for i in range(len(docs.columns) + 1)) if k not in docs.columns)
    return shared.written(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows"), key


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones: that of least doc_id (a row
    without one only where no other has one).  Rows without words are
    similar to nothing and stay."""
    rows, key = _keyed(docs)
    found = ngram_join.similar(rows, id_col=key).select(F.col("doc_id").alias(key), F.col("component_id").alias("group"))
    ids = rows.select(key, F.col("doc_id").alias("id"))
    first = F.struct(F.col("id").isNull(), "id", key)
    heads = found.join(ids.hint("merge"), key).groupBy("group").agg(F.min_by(key, first).alias(key)).select(key)
    return rows.join(heads.hint("merge"), key, "left_semi").select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, key = _keyed(docs)
    leaked = decontaminate.leaks(rows, benchmark, id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(leaked.hint("merge"), key, "left_anti").select(*_columns(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded text, ids."""
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("byte-level BPE", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
