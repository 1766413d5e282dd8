"""The registered queries of the training-data operators, one for each, with
production parameters over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from durata.llm import (
    bpe,
    centroids,
    decontaminate,
    license_scan,
    line_dedup,
    merkle,
    ngram_join,
    packing,
    quality_mil,
    quality_rules,
    sharding,
    shared,
    sql,
    token_store,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
END_ID = 1


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as a token store, and read the files back."""
    path = shared.fresh_path(spark, "op1-store")
    token_store.write(_table(spark, sf_dir, "documents"), path, WORD_TOKENIZER, END_ID)
    return token_store.read(spark, path, with_ids=False)


def _fold(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def _labels(spark: SparkSession, sf_dir: str, label: str, learn) -> DataFrame:
    """doc_id and label of the rows that ``learn`` (a condition) admits."""
    return _table(spark, sf_dir, "labels").filter(learn).select("doc_id", F.col(label).alias("label"))


def _verdict(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias(
        "predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the labels is never seen."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _labels(spark, sf_dir, "toxic", _fold(5) != 0))
    return _verdict(toxicity.score(docs, model), _fold(5) == 0)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to, as digests."""
    return bpe.encode(_table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN, with_ids=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its globally repeated chunks of lines: lines
    before, lines removed and the digest of what stays."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a third of the labels is never seen."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_mil.learn(docs, _labels(spark, sf_dir, "quality", _fold(3) != 1))
    return _verdict(quality_mil.score(docs, model), _fold(3) == 1)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a Jaccard similarity of 0.8 or more."""
    return ngram_join.similar(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other values."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, by document id."""
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, SHARDS, ["doc_id"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the weak-supervision verdict of every document."""
    docs = _table(spark, sf_dir, "documents")
    voted = shared.written(quality_rules.with_votes(quality_rules.measures(docs)), "op10-votes")
    judged = quality_rules.judge(voted, quality_rules.learn(voted))
    return judged.select("doc_id", *quality_rules.BASE_COLUMNS, "base_failed", "kept")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents; a third of them is checked with its
    text's capitals lowered, the rest as it is."""
    docs = _table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    given = merkle.leaf_digest(*[F.col(c) for c in fields])
    claimed = F.when(_fold(3) == 0, merkle.leaf_digest(*[lowered if c == "text" else F.col(c) for c in fields])).otherwise(given)
    found = merkle.manifest(docs.select("doc_id", "lang", given.alias("leaf"), claimed.alias("claimed")), "lang", "doc_id",
                            keep=("claimed",))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
                        merkle.fold(F.col("claimed"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


SEQUENCE = 2048


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces, packed into sequences of 2,048 tokens."""
    pieces = packing.cut(_table(spark, sf_dir, "documents"), WORD_TOKENIZER, SEQUENCE, end_id=0)
    plan = packing.plan(packing.histogram(pieces, SEQUENCE), SEQUENCE)
    digested = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return packing.place(digested, plan)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact clusters of all embeddings."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_quality_mil": op6_quality_mil,
    "op7_ngram_join": op7_ngram_join,
    "op8_decontaminate": op8_decontaminate,
    "op9_sharding": op9_sharding,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle": op11_merkle,
    "op12_packing": op12_packing,
    "op13_centroids": op13_centroids,
}

ORACLE: dict[str, str] = dict(sql.ORACLE)
