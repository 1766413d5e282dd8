"""Streaming ingest equals a batch read of the same page files."""

import datetime as dt
import gzip
import json
import os
from collections import Counter

from pyspark.sql import functions as F

from durata.plans import features as FE
from durata.plans import jobs
from durata.sources.mapping import declared_study, entries
from durata.sources.registry import scan_pages
from durata.streaming import ingest
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark, tmp_path):
    studies = FE.derive_studies(spark, SF_SMALL)
    raw = str(tmp_path / "raw")
    key = F.col("protocolSection.identificationModule.nctId")
    pages = (studies.withColumn("__p", F.floor(F.substring(key, 4, 8).cast("long") / 200))
             .groupBy("__p").agg(F.collect_list(F.struct("protocolSection")).alias("studies"))
             .select("studies", F.lit(None).cast("string").alias("nextPageToken")))
    pages.write.option("compression", "gzip").json(f"{raw}/2001-01-01_batch")

    def rules(s):
        return FE.flatten(s, FE.FLAT_MAPPING, keep=("source_file", "batch_date"))
    ingest.run_ingest(spark, raw, str(tmp_path / "flat"), str(tmp_path / "ckpt"), studies.schema, rules,
                      multi_line=False)
    got = spark.read.parquet(str(tmp_path / "flat")).select("nct_id", "patients", "span_days", "batch_date")
    batch = FE.flatten(scan_pages(spark, raw, studies.schema, multi_line=False), FE.FLAT_MAPPING)
    a = sorted(tuple(r) for r in got.select("nct_id", "patients", "span_days").collect())
    b = sorted(tuple(r) for r in batch.select("nct_id", "patients", "span_days").collect())
    assert a == b and len(a) == studies.count()
    assert {str(r[0]) for r in got.select("batch_date").distinct().collect()} == {"2001-01-01"}
    # a second run finds nothing new (checkpointed)
    ingest.run_ingest(spark, raw, str(tmp_path / "flat"), str(tmp_path / "ckpt"), studies.schema, rules,
                      multi_line=False)
    assert spark.read.parquet(str(tmp_path / "flat")).count() == len(a)


def test_upserts_keep_the_newest_and_replays_change_nothing(spark, tmp_path):
    sheet = entries({"id": "id", "n": "n"}, {"n": "long"})
    raw, table = str(tmp_path / "raw"), ingest.Upserts(spark, str(tmp_path / "t"), "id", buckets=4)

    def rules(s):
        return FE.flatten(s, {"id": "id", "n": "n"}, keep=("source_file", "batch_date"))

    def pages(**kw):
        ingest.run_upserts(spark, raw, table, str(tmp_path / "ckpt"), declared_study(sheet), rules, multi_line=False, **kw)

    def state():
        return {r.id: r.n for r in table.read().collect()}
    _write_gz(raw, "2001-02-01_a.json.gz", [{"id": "a", "n": 1}, {"id": "b", "n": 2}, {"id": None, "n": 9}])
    pages()
    assert state() == {"a": 1, "b": 2, None: 9}
    # an older pull that comes late loses, new ids and newer pulls win, also within one batch
    _write_gz(raw, "2001-01-01_a.json.gz", [{"id": "a", "n": 10}, {"id": "c", "n": 3}])
    _write_gz(raw, "2001-03-01_a.json.gz", [{"id": "b", "n": 20}, {"id": "b", "n": 20}])
    pages()
    want = {"a": 1, "b": 20, "c": 3, None: 9}
    assert state() == want
    # a replay of the committed batch with other rows changes nothing
    rows = spark.createDataFrame([("f", dt.date(2009, 1, 1), "a", 99)], "source_file string, batch_date date, id string, n long")
    table.put(rows, max(table._batches()))
    assert state() == want
    # a batch that wrote rows but no marker is out of sight, and is written again
    n = max(table._batches()) + 1
    rows.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table.folder}/rows/batch={n}")
    assert state() == want
    table.put(rows, n)
    assert state() == {**want, "a": 99}
    assert table.vacuum() > 0 and state() == {**want, "a": 99}
    # nothing new
    _write_gz(raw, "2001-04-01_a.json.gz", [])
    assert len(state()) == 4


def _write_gz(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with gzip.open(os.path.join(folder, name), "wt") as f:
        json.dump({"studies": rows}, f)


def test_scan_pages_max_files(spark, tmp_path):
    studies = FE.derive_studies(spark, SF_SMALL)
    raw = str(tmp_path / "raw")
    key = F.col("protocolSection.identificationModule.nctId")
    pages = (studies.withColumn("__p", F.floor(F.substring(key, 4, 8).cast("long") / 500))
             .groupBy("__p").agg(F.collect_list(F.struct("protocolSection")).alias("studies")))
    pages.where("__p = 0").drop("__p").coalesce(1).write.json(f"{raw}/2001-01-01_batch")
    pages.where("__p > 0").drop("__p").coalesce(1).write.json(f"{raw}/2001-02-01_batch")
    all_rows = scan_pages(spark, raw, studies.schema, multi_line=False).count()
    one = scan_pages(spark, raw, studies.schema, multi_line=False, max_files=1)
    assert 0 < one.count() < all_rows == studies.count()
    assert one.select("source_file").distinct().count() == 1


def test_pages_are_dealt_to_tasks_a_few_at_a_time(spark):
    """No task and no file holds more pages as the studies grow, and the table
    holds a batch on disk, not in the executors' memory."""
    n = 40 * jobs.TASK_PAGES
    s = spark.range(n * 3).select(F.struct(F.col("id").alias("x")).alias("protocolSection")).repartition(3)
    pages = jobs.study_pages(s, F.floor(F.col("protocolSection.x") / 3))
    sizes = pages.select(F.spark_partition_id().alias("p"), F.size("studies").alias("k")).collect()
    assert len(sizes) == n and {r.k for r in sizes} == {3}
    assert pages.rdd.getNumPartitions() == 40
    assert max(Counter(r.p for r in sizes).values()) < 4 * jobs.TASK_PAGES
    got = {x.protocolSection.x for r in pages.collect() for x in r.studies}
    assert got == set(range(n * 3))
    assert jobs.study_pages(s.where("false"), F.lit(1)).count() == 0


def test_a_batch_is_held_on_disk(spark, tmp_path):
    held = []

    class Watched(ingest.Upserts):
        def _current(self, before=None):
            held.append([(i.memSize(), i.numCachedPartitions()) for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()])
            return super()._current(before)
    rows = spark.range(2_000).select(F.lit("f").alias("source_file"), F.lit(dt.date(2009, 1, 1)).alias("batch_date"),
                                     F.format_string("%05d", "id").alias("id"))
    spark.catalog.clearCache()
    table = Watched(spark, str(tmp_path / "t"), "id", buckets=4)
    table.put(rows, 0)
    assert any(n for _, n in held[0]) and all(m == 0 for m, _ in held[0])
    assert table.read().count() == 2_000


def test_a_batch_without_repeats_is_not_shuffled(spark, tmp_path, monkeypatch):
    """Ids and versions alone are compared (F3): rows move only where a batch repeats an id or an older row stays."""
    moved, real = [], ingest.latest_versions
    monkeypatch.setattr(ingest, "latest_versions", lambda *a, **kw: moved.append(1) or real(*a, **kw))
    table = ingest.Upserts(spark, str(tmp_path / "t"), "id", buckets=4)

    def put(n, date, ids, file="f"):
        rows = [(file, dt.date(2009, date, 1), i, 100 * n + k) for k, i in enumerate(ids)]
        table.put(spark.createDataFrame(rows, "source_file string, batch_date date, id string, n long"), n)
        return {r.id: r.n for r in table.read().collect()}
    assert put(0, 1, ["a", "b", None]) == {"a": 0, "b": 1, None: 2} and not moved
    assert put(1, 2, ["b", "a", None, "c"]) == {"b": 100, "a": 101, None: 102, "c": 103} and not moved
    assert put(2, 3, ["a"]) == {"b": 100, "a": 200, None: 102, "c": 103}
    assert put(3, 1, ["c", "d"]) == {"b": 100, "a": 200, None: 102, "c": 103, "d": 301}
    got = put(4, 4, ["e", "e"])
    assert got.pop("e") in (400, 401) and got == {"b": 100, "a": 200, None: 102, "c": 103, "d": 301} and moved
    assert table.read().columns[:4] == ["source_file", "batch_date", "id", "n"]
    assert not os.path.exists(f"{table.folder}/staged/batch=4")


def test_pulls_come_from_one_pass_over_slices_and_free_their_shuffles(spark, monkeypatch):
    """No more than a slice's pages are on disk as shuffle files."""
    whole = sorted(tuple(r) for r in jobs.JOBS["w6_stream_ingest"](spark, SF_SMALL).collect())
    passes, real = [], jobs.study_pages
    monkeypatch.setattr(jobs, "SLICE_STUDIES", 400)
    monkeypatch.setattr(jobs, "study_pages", lambda s, page: passes.append(s.count()) or real(s, page))
    table = jobs.JOBS["w6_stream_ingest"](spark, SF_SMALL)
    assert sorted(tuple(r) for r in table.collect()) == whole and sum(passes) == len(whole)
    assert not os.path.exists(table.inputFiles()[0].removeprefix("file:").split("/studies/")[0] + "/derived/slice=0")


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    from durata.session import freed_shuffles
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with freed_shuffles(spark):
        assert spark.conf.get(name) == "true"
        spark.range(1_000).repartition(5, "id").write.parquet(str(tmp_path / "t"))
    assert spark.conf.get(name) == before and spark.read.parquet(str(tmp_path / "t")).count() == 1_000
