"""Command line for the file-based workflow (each step is one Spark job).

    python -m durata.cli flatten    --pages DIR --mapping CSV --out PATH [--max-files N] [--latest-only] [--infer]
                               [--malformed fail|keep]
    python -m durata.cli fit-scores --features PATH --out DIR
    python -m durata.cli features   --flat PATH --out PATH --as-of DATE [--scores DIR]
    python -m durata.cli score-report --features PATH --out DIR [--bins N]
    python -m durata.cli embed      --flat PATH --out PATH [--ids-txt FILE] [--dims 256]
    python -m durata.cli merge-text --base PATH --vectors PATH --out PATH
    python -m durata.cli evaluate   --features PATH --train-ids FILE --test-ids FILE --out DIR [--overlap test]
    python -m durata.cli ablate     --features PATH --train-ids FILE --test-ids FILE --out DIR
    (ablate-by-study, engineered, experts: same arguments)

The master, shuffle partitions and checkpoint folder come from the usual
``spark-submit`` settings; nothing here assumes a local machine.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .operators import ablation, embed, model, reports, scores, split, vectors
from .operators.flatten import flatten
from .plans import features as FE
from .plans.jobs import CAT_COLS, NUM_COLS
from .session import checkpoint_dir
from .sources import idlists, mapping, registry
from .streaming.ingest import batch_date, latest_versions


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("durata").getOrCreate()
    checkpoint_dir(spark)
    return spark


def _ids(spark, path: str) -> DataFrame:
    """ID list file: first whitespace-separated column, upper-cased, unique."""
    return idlists.ids_first_column(idlists.read_lines(spark, path))


def cmd_flatten(spark, a):
    """Pages -> flat rows, each page read once with the schema the sheet
    declares; ``OUT_pages`` counts every file's studies and those with a value
    of another type (their texts are in the column ``unparsed``)."""
    sheet = mapping.read_sheet(spark, a.mapping, FE.FLAT_TYPES)
    study = registry.infer_study(spark, a.pages, max_files=a.max_files) if a.infer else mapping.declared_study(sheet)
    df = registry.scan_pages(spark, a.pages, study, multi_line=True, max_files=a.max_files, malformed=a.malformed)
    df = df.withColumn("batch_date", batch_date("source_file"))
    paths = {e.variable: e.path for e in sheet}
    flat = flatten(df, paths, keep=("source_file", "batch_date", "unparsed"))
    if a.latest_only:
        flat = latest_versions(flat, "nct_id" if "nct_id" in flat.columns else list(paths)[0])
    if {"start_date_raw", "complete_date_raw"} <= set(flat.columns):
        registry.write_clustered(FE.typed_flat(flat), a.out, "typed_start_year")
    else:
        registry.write_parquet(flat.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), a.out)
    registry.write_csv(registry.page_counts(spark.read.parquet(a.out)), a.out.rstrip("/") + "_pages")


def cmd_fit_scores(spark, a):
    f = spark.read.parquet(a.features).persist()
    c = scores.fit_complexity(f, "duration_days", id_col="nct_id")
    t = scores.fit_attractiveness(f)
    spark.createDataFrame([(c.kind, c.to_json()), (t.kind, t.to_json())], "kind string, model string") \
        .coalesce(1).write.mode("overwrite").json(a.out)


def _load_scores(spark, path):
    rows = spark.read.json(path).collect()
    return [scores.ScoreModel.from_json(r["model"]) for r in sorted(rows, key=lambda r: r["kind"] != "complexity")]


def cmd_features(spark, a):
    flat = spark.read.parquet(a.flat)
    models = _load_scores(spark, a.scores) if a.scores else None
    f = FE.build_features(flat, a.as_of, score_models=models,
                          start_floor=a.start_floor, keep_raw=a.keep_raw)
    # the report's numbers are gathered while the features are written
    f, seen = reports.observed_build(f)
    registry.write_parquet(f, a.out)
    report = [(k, None if v is None else str(v)) for k, v in seen.get.items()]
    registry.write_csv(spark.createDataFrame(report, "measure string, value string").coalesce(1),
                       a.out.rstrip("/") + "_report")


def cmd_score_report(spark, a):
    """Distribution of the fitted scores: describe, histogram and box data."""
    f = spark.read.parquet(a.features)
    cols = [c for c in ("complexity_score_100", "attractiveness_score_100", "novelty_score") if c in f.columns]
    out = a.out.rstrip("/")
    for kind, make in (("describe", reports.describe), ("histogram", lambda d, c: reports.histogram(d, c, a.bins)),
                       ("box", reports.box_stats)):
        registry.write_csv(reports.concat_blocks([(c, make(f, c)) for c in cols], "score"), f"{out}/{kind}")


def cmd_embed(spark, a):
    flat = spark.read.parquet(a.flat)
    ids = None
    if a.ids_txt:
        ids = idlists.ids_tokens(idlists.read_lines(spark, a.ids_txt))
    t = embed.summary_table(flat.withColumn("nct_id", R.normalise_id("nct_id")), "nct_id", a.text_col, ids)
    v = embed.embed(t, "nct_id", a.text_col, dims=a.dims)
    registry.write_parquet(embed.expand(v, "vector", a.dims, "brief_han_"), a.out)


def cmd_merge_text(spark, a):
    base = spark.read.parquet(a.base)
    vec = spark.read.parquet(a.vectors)
    cols = [c for c in vec.columns if c.startswith("brief_han_")]
    v = vec.select("nct_id", F.array(*cols).alias("__v"))
    merged = vectors.vector_left_join(base, "nct_id", v, "nct_id", "__v")
    merged = merged.select(*base.columns, *[F.col("__v")[i].alias(c) for i, c in enumerate(cols)])
    registry.write_parquet(merged, a.out)
    reports_df = vectors.coverage(merged.withColumn("__v", F.array(*cols)), "__v")
    registry.write_csv(reports_df, a.out.rstrip("/") + "_coverage")


def _split(spark, a):
    f = spark.read.parquet(a.features)
    s = split.assign_split(f, "nct_id", _ids(spark, a.train_ids), _ids(spark, a.test_ids), overlap=a.overlap or "test")
    return s.where("split = 'train'"), s.where("split = 'test'")


def _rf(a):
    return {k: v for k, v in dict(numTrees=a.trees, maxDepth=a.depth).items() if v}


def cmd_evaluate(spark, a):
    tr, te = _split(spark, a)
    num = NUM_COLS + [c for c in tr.columns if c.startswith("brief_han_")]
    out = a.out.rstrip("/")
    preds, per_seed, imps = model.evaluate(tr, te, num, CAT_COLS, "nct_id", "duration_days",
                                           seeds=a.seeds, rf_params=_rf(a), folder=f"{out}/fits")
    registry.write_csv(preds, f"{out}/predictions")
    registry.write_csv(per_seed, f"{out}/metrics_per_seed")
    mean = model.mean_baseline(tr, "duration_days")
    base = te.select(F.col("duration_days").cast("double").alias("truth"), F.lit(mean).alias("pred"))
    registry.write_csv(reports.error_metrics(base, "truth", "pred", scale=365.25), f"{out}/mean_baseline")
    registry.write_csv(reports.seed_summary(per_seed.withColumn("model", F.lit("random_forest")), ["model"]),
                       f"{out}/summary")
    registry.write_csv(reports.per_entity_stats(preds, "nct_id", "abs_err", "truth", "pred"), f"{out}/per_trial")
    registry.write_csv(imps.orderBy(F.desc("importance")), f"{out}/importance")
    registry.write_csv(model.top_importances(imps), f"{out}/importance_top")


def _summary(m: DataFrame, by: list[str], order: list) -> DataFrame:
    return reports.seed_summary(m, [*by, "is_baseline"]).orderBy(*order)


def cmd_ablate(spark, a):
    tr, te = (ablation.study_frame(x) for x in _split(spark, a))
    cols = [c for c in ablation.RAW + ablation.DERIVED + ablation.ENGINEERED if c in tr.columns]
    sets, baselines = ablation.global_sets(cols)
    num, cat = ablation.column_kinds(tr, cols)
    out = a.out.rstrip("/")
    m = ablation.run_sets(tr, te, num, cat, "nct_id", "duration_days", sets, seeds=a.seeds, rf_params=_rf(a),
                          baseline_sets=baselines, folder=f"{out}/fits")
    registry.write_csv(m, f"{out}/metrics")
    registry.write_csv(_summary(m, ["feature_set"], [F.desc("is_baseline"), F.desc("mae_mean")]), f"{out}/summary")


def cmd_ablate_by_study(spark, a):
    tr, te = (ablation.study_frame(x) for x in _split(spark, a))
    out = a.out.rstrip("/")
    m = ablation.run_studies(tr, te, "nct_id", "duration_days", seeds=a.seeds, rf_params=_rf(a), folder=f"{out}/fits")
    registry.write_csv(m, f"{out}/metrics")
    registry.write_csv(_summary(m, ["study", "study_order", "feature_set"],
                                ["study_order", F.desc("is_baseline"), F.desc("mae_mean")]), f"{out}/summary")


def cmd_engineered(spark, a):
    tr, te = _split(spark, a)
    num, cat = ablation.column_kinds(tr, [c for c in ablation.ENGINEERED if c in tr.columns])
    m = ablation.run_sets(tr, te, num, cat, "nct_id", "duration_days", ablation.engineered_sets(tr.columns),
                          seeds=a.seeds, rf_params=_rf(a), baseline_sets=("ALL_ENGINEERED",), folder=f"{a.out.rstrip('/')}/fits")
    out = a.out.rstrip("/")
    registry.write_csv(m, f"{out}/metrics")
    registry.write_csv(_summary(m, ["feature_set"], [F.desc("is_baseline"), F.desc("mae_mean")]), f"{out}/summary")


def cmd_experts(spark, a):
    """Comparison on an ordered test list: overlap goes to training, results
    stay in list order, requested but absent ids are reported, and the runs'
    errors are summed up (mean and spread of their MAE in years)."""
    f = spark.read.parquet(a.features)
    order = idlists.ids_ordered(idlists.read_lines(spark, a.test_ids, ordered=True))
    s = split.assign_split(f, "nct_id", _ids(spark, a.train_ids), order.select("id"), overlap=a.overlap or "train")
    tr, te = s.where("split = 'train'"), s.where("split = 'test'")
    out = a.out.rstrip("/")
    preds, runs, _ = model.evaluate(tr, te, NUM_COLS, CAT_COLS, "nct_id", "duration_days", seeds=a.seeds, rf_params=_rf(a),
                                    folder=f"{out}/fits")
    stats = reports.per_entity_stats(preds, "nct_id", "abs_err", "truth", "pred")
    registry.write_csv(runs, f"{out}/metrics_per_seed")
    registry.write_csv(reports.seed_summary(runs.withColumn("model", F.lit("random_forest")), ["model"]), f"{out}/summary")
    registry.write_csv(split.ordered_by_list(stats, "nct_id", order), f"{out}/per_trial")
    registry.write_csv(split.absent_ids(order.select("id"), f, "nct_id"), f"{out}/absent")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="durata")
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("flatten")
    s.add_argument("--pages", required=True), s.add_argument("--mapping", required=True)
    s.add_argument("--out", required=True), s.add_argument("--max-files", type=int)
    s.add_argument("--latest-only", action="store_true")
    s.add_argument("--infer", action="store_true"), s.add_argument("--malformed", default="fail", choices=["fail", "keep"])
    s = sub.add_parser("fit-scores")
    s.add_argument("--features", required=True), s.add_argument("--out", required=True)
    s = sub.add_parser("features")
    s.add_argument("--flat", required=True), s.add_argument("--out", required=True)
    s.add_argument("--as-of", required=True), s.add_argument("--scores")
    s.add_argument("--start-floor", default="2000-01-01"), s.add_argument("--keep-raw", action="store_true")
    s = sub.add_parser("score-report")
    s.add_argument("--features", required=True), s.add_argument("--out", required=True)
    s.add_argument("--bins", type=int, default=30)
    s = sub.add_parser("embed")
    s.add_argument("--flat", required=True), s.add_argument("--out", required=True)
    s.add_argument("--ids-txt"), s.add_argument("--dims", type=int, default=256)
    s.add_argument("--text-col", default="brief_summary")
    s = sub.add_parser("merge-text")
    s.add_argument("--base", required=True), s.add_argument("--vectors", required=True)
    s.add_argument("--out", required=True)
    for name in ("evaluate", "ablate", "ablate-by-study", "engineered", "experts"):
        s = sub.add_parser(name)
        s.add_argument("--features", required=True), s.add_argument("--train-ids", required=True)
        s.add_argument("--test-ids", required=True), s.add_argument("--out", required=True)
        s.add_argument("--overlap", choices=["test", "train"])  # experts: train, else test
        s.add_argument("--seeds", type=int, nargs="+", default=list(model.SEEDS))
        s.add_argument("--trees", type=int), s.add_argument("--depth", type=int)
    a = p.parse_args(argv)
    spark = _spark()
    {"flatten": cmd_flatten, "fit-scores": cmd_fit_scores, "features": cmd_features,
     "score-report": cmd_score_report, "embed": cmd_embed,
     "merge-text": cmd_merge_text, "evaluate": cmd_evaluate, "ablate": cmd_ablate,
     "ablate-by-study": cmd_ablate_by_study, "engineered": cmd_engineered, "experts": cmd_experts}[a.cmd](spark, a)


if __name__ == "__main__":
    main()
