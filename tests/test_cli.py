"""The file-based workflow end to end through the command line."""

from pyspark.sql import functions as F

from durata import cli
from durata.plans import features as FE
from tests.conftest import SF_SMALL


def test_workflow(spark, tmp_path):
    studies = FE.derive_studies(spark, SF_SMALL)
    key = F.col("protocolSection.identificationModule.nctId")
    pages = (studies.withColumn("__p", F.floor(F.substring(key, 4, 8).cast("long") / 500))
             .groupBy("__p").agg(F.collect_list(F.struct("protocolSection")).alias("studies"))).persist()
    for (p,) in pages.select("__p").collect():  # one JSON document per page file
        pages.where(F.col("__p") == p).drop("__p").coalesce(1).write.json(str(tmp_path / f"raw/2001-01-0{p + 1}_batch"))
    mapping = tmp_path / "mapping.csv"
    mapping.write_text("variable_wishlist,ctgov_field\n" + "".join(f"{k},{v}\n" for k, v in FE.FLAT_MAPPING.items()))
    t = lambda n: str(tmp_path / n)
    cli.main(["flatten", "--pages", t("raw"), "--mapping", str(mapping), "--out", t("flat")])
    flat = spark.read.parquet(t("flat"))
    assert flat.count() == studies.count() and "span_days" in flat.columns
    cli.main(["features", "--flat", t("flat"), "--out", t("f0"), "--as-of", "2002-12-31", "--start-floor", "1995-01-01"])
    cli.main(["fit-scores", "--features", t("f0"), "--out", t("scores")])
    cli.main(["features", "--flat", t("flat"), "--out", t("f1"), "--as-of", "2002-12-31", "--start-floor", "1995-01-01",
              "--scores", t("scores")])
    f1 = spark.read.parquet(t("f1"))
    assert {"complexity_score_100", "attractiveness_score_100", "start_date_ts"} <= set(f1.columns)
    ids = [r.nct_id for r in f1.select("nct_id").orderBy("nct_id").collect()]
    (tmp_path / "train.txt").write_text("\n".join(ids[: len(ids) * 2 // 3]) + "\n")
    (tmp_path / "test.txt").write_text("\n".join(x.lower() + "  extra" for x in ids[len(ids) * 2 // 3:]) + "\n")
    cli.main(["embed", "--flat", t("flat"), "--out", t("vec"), "--dims", "16"])
    cli.main(["merge-text", "--base", t("f1"), "--vectors", t("vec"), "--out", t("merged")])
    merged = spark.read.parquet(t("merged"))
    assert merged.count() == f1.count() and "brief_han_015" in merged.columns
    cli.main(["evaluate", "--features", t("merged"), "--train-ids", t("train.txt"), "--test-ids", t("test.txt"),
              "--out", t("eval"), "--seeds", "42", "43", "--trees", "3", "--depth", "3"])
    preds = spark.read.option("header", True).csv(t("eval/predictions"))
    assert preds.count() == 2 * (len(ids) - len(ids) * 2 // 3)
    cli.main(["ablate", "--features", t("f1"), "--train-ids", t("train.txt"), "--test-ids", t("test.txt"),
              "--out", t("abl"), "--seeds", "42", "--trees", "2", "--depth", "2"])
    assert spark.read.option("header", True).csv(t("abl/summary")).count() > 5
