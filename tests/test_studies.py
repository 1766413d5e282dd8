"""Feature-set studies, contiguous folds, per-row vectors, lossless pages."""

import json

import pytest
from pyspark.sql import functions as F

from durata.operators import ablation, embed, model, ranks, scores
from durata.operators.flatten import flatten
from durata.sources import registry


def test_study_sets_and_order():
    cols = ablation.RAW + ablation.DERIVED + ablation.ENGINEERED
    assert len(cols) == len(set(cols)) == 36
    sets, baselines = ablation.global_sets(cols)
    assert baselines == list(sets)[:3] == ["ALL", "RAW", "RAW+DERIVED"]
    assert [len(sets[b]) for b in baselines] == [36, 7, 31] and len(sets) == 3 + 36
    assert all(len(v) == 35 for k, v in sets.items() if k not in baselines)
    assert list(ablation.engineered_sets(cols).values()) == [ablation.ENGINEERED] + [[c] for c in ablation.ENGINEERED]
    sizes = [(len(base), len(left)) for _, base, left in ablation.STUDIES.values()]
    assert sizes == [(7, 7), (31, 24)]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(f"i{k:03d}", float(k % 7), float(k % 3), "ab"[k % 2], k % 2, 10.0 * (k % 7) + k % 5) for k in range(160)]
    return spark.createDataFrame(rows, "id string, patients double, site_n double, phase string, placebo_flag int, y double")


def test_run_studies(spark, small):
    f = ablation.study_frame(small)
    assert dict(f.dtypes)["placebo_flag"] == "string"
    studies = {"S1": ("all", ["patients", "phase"], ["patients", "phase"]),
               "S2": ("more", ["patients", "site_n", "placebo_flag"], ["site_n", "absent"]), "S3": ("none", ["absent"], [])}
    m = ablation.run_studies(f, f, "id", "y", studies, seeds=(1,), rf_params=dict(numTrees=2, maxDepth=2)).orderBy(
        "study_order", "position").collect()
    assert [(r.study, r.feature_set, r.is_baseline) for r in m] == [
        ("S1", "all", 1), ("S1", "all - patients", 0), ("S1", "all - phase", 0), ("S2", "more", 1), ("S2", "more - site_n", 0)]
    assert m[1].mae > m[0].mae and all(r.n == 160 for r in m)


def test_hashed_columns_have_fixed_slots(spark):
    df = spark.createDataFrame([(f"i{k}", float(k), f"c{k}", float(k)) for k in range(400)],
                               "id string, a double, condition_top string, y double")
    tr, _, _ = model.prepare(df, df, ["a"], ["condition_top"], "id", "y")
    assert tr.first().features.size == 1 + model.HASH_SLOTS
    names = model.feature_names(tr)
    assert len(ablation.slots_by_column(names, ["a", "condition_top"])["condition_top"]) == model.HASH_SLOTS


@pytest.mark.parametrize("n,folds", [(23, 5), (5, 5), (4, 5), (100, 3)])
def test_contiguous_folds(spark, n, folds):
    df = spark.createDataFrame([(f"id{k:03d}",) for k in range(n)], "id string").repartition(4)
    got = df.select("id", ranks.contiguous_folds(df, "id", folds).alias("f")).orderBy("id").collect()
    want = [k for k in range(folds) for _ in range(n // folds + (k < n % folds))]
    assert [r.f for r in got] == want


def test_exact_quantiles(spark):
    np = pytest.importorskip("numpy")
    a = [float(x) for x in np.random.default_rng(0).integers(0, 40, 501)]
    df = spark.createDataFrame([(x, None, 3.0) for x in a], "a double, b double, c double").repartition(5)
    ps = [0, 0.05, 0.25, 0.5, 0.77, 1]
    got = ranks.exact_quantiles(df, ["a", "b", "c"], ps)
    assert np.allclose(got["a"], np.quantile(a, ps)) and got["b"] is None and got["c"] == [3.0] * 6


def test_scores_survive_one_year_constant_and_empty_columns(spark):
    rows = [(f"n{k:02d}", 100.0 + k, 5.0, None, float(k % 4), float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "nct_id string, duration_days double, a double, b double, c double, d double")
    m = scores.fit_complexity(df, "duration_days", ["a", "b", "c", "d"], id_col="nct_id", n_quantiles=10)
    s = [r[0] for r in m.transform(df).select(m.out).collect()]
    assert min(s) == 0 and abs(max(s) - 100) < 1e-9
    flat = scores.fit_complexity(df, "duration_days", ["a", "b"], id_col="nct_id", n_quantiles=10)
    assert {r[0] for r in flat.transform(df).select(flat.out).collect()} == {0.0}


def test_vectors_of_equal_ids_stay_apart(spark):
    df = spark.createDataFrame([(1, "alpha beta. gamma"), (1, "delta"), (2, None), (2, "delta")], "id long, t string")
    got = [(r.id, tuple(r.vector)) for r in embed.embed(df, "id", "t", dims=16).collect()]
    assert len(got) == 4 and len({v for i, v in got if i == 1}) == 2
    assert sum(v == (0.0,) * 16 for _, v in got) == 1
    delta = [v for _, v in got if sum(x > 0 for x in v) == 1]
    assert len(set(delta)) == 1


def test_encoder_hook(spark):
    def enc(texts):
        return [[float(len(t)), 1.0] for t in texts]
    df = spark.createDataFrame([(1, "abc"), (1, "x"), (2, None)], "id long, t string")
    got = sorted((r.id, list(r.vector)) for r in embed.embed(df, "id", "t", dims=2, encoder=enc, clean=False).collect())
    assert got == [(1, [1.0, 1.0]), (1, [3.0, 1.0]), (2, [0.0, 1.0])]


def test_field_first_seen_in_the_last_page(spark, tmp_path):
    for k in range(6):
        study = {"id": f"NCT{k}", **({"late": {"x": "asthma"}} if k == 5 else {})}
        (tmp_path / f"2020-01-0{k + 1}_batch001.json").write_text(json.dumps({"studies": [study], "nextPageToken": None}))
    study = registry.infer_study(spark, str(tmp_path))
    flat = flatten(registry.scan_pages(spark, str(tmp_path), study), {"nct": "id", "indication": "late.x"})
    assert {r.nct: r.indication for r in flat.collect()} == {**{f"NCT{k}": None for k in range(5)}, "NCT5": "asthma"}


def test_malformed_page_stops_the_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"studies": [{"id": "1"}]}')
    study = registry.infer_study(spark, str(tmp_path))
    (tmp_path / "b.json").write_text('{"studies": [{"id": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        registry.scan_pages(spark, str(tmp_path), study).select(F.count("id")).collect()
