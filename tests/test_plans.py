"""Plan-shape checks: rules stay JVM-side, filters and columns reach the scan."""

import __spark_entry__ as E
from durata.plans import features as FE
from durata.plans import jobs
from durata.sources import registry
from tests.conftest import SF_SMALL

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_rule_queries(spark):
    for name, fn in E.queries().items():
        if name.startswith("q") and name != "q32_clean_text":
            p = plan(fn(spark, SF_SMALL))
            assert not any(n in p for n in PY_NODES), name


def test_entity_decoding_is_the_only_python_step(spark):
    p = plan(E.queries()["q32_clean_text"](spark, SF_SMALL))
    assert "ArrowEvalPython" in p


def test_pushdown_and_pruning(spark):
    df = E.queries()["q01_cohort"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    # the join key and the date range reach the scan of orders
    scan = next(x for x in p.split("FileScan") if "orders.parquet" in x)
    pushed = scan[scan.index("PushedFilters:"):]
    assert "IsNotNull(o_orderkey)" in pushed and "GreaterThanOrEqual(o_orderdate" in pushed, pushed
    # lineitem is read with the three columns the query needs only
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in p


def test_classification_is_narrow(spark):
    p = plan(E.queries()["q09_classify"](spark, SF_SMALL))
    assert "Exchange" not in p


def test_cohort_filter_prunes_a_clustered_table(spark, tmp_path):
    """Years are partition filters, dates and texts pushed filters; the
    features are those of the plain table."""
    flat = FE.flatten(FE.derive_studies(spark, SF_SMALL, with_summary=False), FE.FLAT_MAPPING)
    registry.write_clustered(FE.typed_flat(flat), str(tmp_path / "t"), "typed_start_year")
    table = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    scan = plan(FE.clustered_cohort(table, jobs.AS_OF, "1996-07-01").select("nct_id"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = scan[scan.index("PartitionFilters:"):]
    partition, pushed = filters.split("PushedFilters:")
    assert "typed_start_year" in partition and "1996" in partition
    for part in ("GreaterThanOrEqual(typed_start,1996-07-01)", "LessThanOrEqual(typed_complete,", "In(typed_status,",
                 "EqualTo(typed_completion,ACTUAL)"):
        assert part in pushed, (part, pushed)
    assert len(list((tmp_path / "t").glob("typed_start_year=*/*.parquet"))) <= 10

    def rows(d):
        f = FE.build_features(d, jobs.AS_OF, start_floor="1996-07-01")
        return sorted(map(repr, f.select(sorted(f.columns)).collect()))
    assert rows(table) == rows(flat) != []
