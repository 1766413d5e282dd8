"""Mapping sheet, sinks, model persistence, small report operators."""

import json
import os

from pyspark.sql import functions as F

from durata.operators import embed, model, reports, vectors
from durata.operators.scores import ScoreModel, fit_attractiveness
from durata.sources import registry


def test_mapping_sheet_last_wins(spark, tmp_path):
    p = tmp_path / "mapping.csv"
    p.write_text("variable_wishlist,ctgov_field\nnct_id,a.id\nphase,a.p[0]\nnct_id,a.nct\nunused,\n")
    m = registry.read_mapping(spark, str(p))
    assert m == {"nct_id": "a.nct", "phase": "a.p[0]"}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1234567891, "x"), (2, 2.0, "y")], "k long, v double, s string")
    registry.write_parquet(df, str(tmp_path / "pq"), partition_by=["s"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2
    registry.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    registry.write_json(df, str(tmp_path / "js"))
    vals = sorted(r.v for r in spark.read.json(str(tmp_path / "js")).collect())
    assert vals == [0.123457, 2.0]


def test_pipeline_and_score_persistence(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 7), "a" if i % 2 else "b") for i in range(60)],
                               "x double, y double, c string")
    prep = model.ImputeScale(["x"], ["c"], index=False).fit(df)
    pipe = model.design_pipeline(["x"], ["c"]).fit(prep.transform(df))
    model.save_pipeline(pipe, str(tmp_path / "pipe"))
    again = model.load_pipeline(str(tmp_path / "pipe"))
    a = [r.features for r in pipe.transform(prep.transform(df)).collect()]
    b = [r.features for r in again.transform(prep.transform(df)).collect()]
    assert a == b
    sm = fit_attractiveness(df, cols=["x", "y"], n_quantiles=10)
    sm2 = ScoreModel.from_json(sm.to_json())
    s1 = [r[0] for r in sm.transform(df).select("attractiveness_score_100").collect()]
    s2 = [r[0] for r in sm2.transform(df).select("attractiveness_score_100").collect()]
    assert s1 == s2


def test_reports(spark):
    m = spark.createDataFrame([("base", 1, 2.0), ("m1", 0, 1.0), ("m2", 0, 3.0)], "name string, is_b int, mae_mean double")
    assert [r.name for r in reports.sort_summary(m, baseline_flag="is_b").collect()] == ["base", "m2", "m1"]
    f = spark.createDataFrame([(10, "P1", 5.0), (None, "P2", 7.0), (40, "P1", None)],
                              "duration_days int, phase string, complexity_score_100 double")
    r = reports.build_report(f).first()
    assert (r.rows, r.durations_non_null, r.duration_min, r.duration_max, r.phase_distinct) == (3, 2, 10, 40, 2)
    assert (r.complexity_score_100_min, r.complexity_score_100_max) == (5.0, 7.0)
    # the same numbers from the write alone
    watched, seen = reports.observed_build(f)
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == r.asDict()


def test_vectors_and_summary(spark):
    base = spark.createDataFrame([(" nct1 ", "t1"), ("NCT2", None), (None, "t3")], "id string, txt string")
    vec = spark.createDataFrame([("NCT1", [1.0, 2.0]), ("nct2", [1.0, None])], "vid string, v array<double>")
    j = vectors.vector_left_join(base, "id", vec, "vid", "v")
    assert j.select(F.sum(vectors.missing_vector("v"))).first()[0] == 2
    assert vectors.coverage(j, "v").first().rows_missing == 2
    ids = spark.createDataFrame([("NCT2",)], "id string")
    s = embed.summary_table(base, "id", "txt", ids)
    assert [tuple(r) for r in s.collect()] == [("NCT2", "")]


def test_sentence_caps_and_first_absent(spark):
    from durata.operators import split
    df = spark.createDataFrame([(1, ". ".join(["w " * 40] * 50))], "id long, t string")
    whole = embed.sentence_table(df, "id", "t")
    capped = embed.sentence_table(df, "id", "t", max_sentences=40, max_tokens=32)
    assert whole.count() == 50 and capped.count() == 40
    assert capped.select(F.max(F.size("tokens"))).first()[0] == 32
    ids = spark.createDataFrame([(i,) for i in (9, 3, 7, 1, 5, 11, 13)], "id long")
    have = spark.createDataFrame([(1,), (5,)], "k long")
    assert [r.k for r in split.first_absent(ids, have, "k", 3).collect()] == [3, 7, 9]
