import base64
import hashlib

import duckdb
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from durata.llm import shared, sql
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import plain
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_line_dedup import chunk_table
from tests.llm.test_ngram_join import brute as brute_groups


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    texts = dict(pairs(docs))
    one = shared.written(cp.quality(spark, docs, SF_SMALL), "t")
    assert one.columns == docs.columns
    kept = {r[0] for r in c.execute(f"SELECT doc_id FROM ({sql.ORACLE['op10_quality_rules']}) WHERE kept").fetchall()}
    assert set(pairs(one)) == {(d, texts[d]) for d in kept}
    two = shared.written(cp.lines(spark, one, SF_SMALL), "t")
    rows = pairs(one)
    assert two.columns == docs.columns
    assert sorted(pairs(two)) == brute_sorted(brute_lines(rows, chunk_table(spark, rows)))
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = shared.written(cp.near_duplicates(spark, two, SF_SMALL), "t")
    rows = pairs(two)
    assert {d for d, _ in pairs(three)} == {d for d, _, g in brute_groups(rows) if d == g}
    assert three.columns == docs.columns
    four = shared.written(cp.decontamination(spark, three, SF_SMALL), "t")
    items = [f" {plain(t)} " for t, in c.execute("SELECT text FROM benchmark").fetchall()]
    clean = {d for d, t in pairs(three) if not any(q in f" {plain(t)} " for q in items)}
    left = {d for d, _ in pairs(four)}
    assert left <= clean and len(clean - left) <= 1
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(cp.RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(pairs(four))
    for r in cp.encoding(spark, four, SF_SMALL).collect():
        assert list(r.ids) == lib.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def brute_sorted(rows):
    return sorted(rows)


def test_run_and_stage_names(spark):
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
    assert 0 < cp.run(spark, SF_SMALL).count() <= 200


ODD = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", None, None, None),
       (4, "word " * 30_000, "en", "s", 1)] + [
    (k, "One good line of plain words here.\nAnd another good line of other words there.", "en", "s", 5) for k in (5, 5, 6)]


def test_odd_rows_and_empty_table(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(ODD, schema)
    for rows in (df, df.filter("false")):
        docs = rows
        for name, stage in cp.STAGES:
            docs = shared.written(stage(spark, docs, SF_SMALL), "t")
            if name != cp.STAGES[-1][0]:
                assert docs.dtypes == df.dtypes
        if rows is not df:
            assert docs.count() == 0
    near = cp.near_duplicates(spark, df, SF_SMALL).collect()
    assert sorted((r.doc_id or 0) for r in near) == [0, 1, 2, 4, 5]


BASE = " ".join(f"word{i} and{i}" for i in range(40))


def test_near_duplicates_decide_by_row(spark):
    """Copies under a repeated id or none go, other texts under them stay;
    columns with any name come through."""
    rows = [(3, BASE, 1, "a"), (5, BASE + " more", 2, "b"), (5, "other text of its own", 3, "c"), (None, BASE, 4, "d"),
            (None, "one more text without an id", 5, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, __mark string").withColumn("row_0", F.lit(1))
    out = cp.near_duplicates(spark, df, SF_SMALL)
    assert out.columns == df.columns and {r["a.b"] for r in out.collect()} == {1, 3, 5}
    assert {(r["a.b"], r["__mark"]) for r in out.collect()} == {(1, "a"), (3, "c"), (5, "e")}
    assert cp.quality(spark, df.withColumns({c: F.lit("x") for c in ("lang", "source")}), SF_SMALL).columns[2:4] == ["a.b", "__mark"]


def test_decontamination_decides_by_row(spark):
    leak = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first().text
    rows = [(7, leak, 1), (7, "clean text", 2), (None, leak, 3), (None, "clean too", 4), (8, "and this", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    assert {r["a.b"] for r in cp.decontamination(spark, df, SF_SMALL).collect()} == {2, 4, 5}
