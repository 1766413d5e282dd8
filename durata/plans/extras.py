"""Catalogue, part two: page scan, sinks, schema guards, ordered summaries,
summary texts, labels, numeric profiles and one-hot slots."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import cohort, embed, harmonise, model, reports
from ..operators.flatten import flatten
from ..session import staging_path
from ..sources import registry
from ..sources.mapping import Entry, declared_study
from .catalogue import T, _q34_inputs, query, r4


def _fresh(spark, name):
    return staging_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("q37_page_scan", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status,
       CASE WHEN o_orderkey % 100 <> 3 THEN round(CAST(o_totalprice AS DOUBLE), 4) END AS total,
       o_orderpriority AS first_tag, CASE WHEN o_orderkey % 1000 = 7 THEN 'late' END AS rare,
       CAST(NULL AS VARCHAR) AS missing, CAST(o_orderkey % 100 = 3 AS BIGINT) AS misfits
FROM orders
""")
def q37(spark, sf):
    """Orders as gzip pages of many lines, read once with the
    schema that the sheet declares; one field stands in one study of a
    thousand, one study of a hundred has a total that is no number."""
    o = T(spark, sf, "orders")
    study = F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("total")).alias("info"),
        F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("tags"), F.lit("not in the sheet").alias("more"),
        F.when(F.col("o_orderkey") % 1000 == 7, F.struct(F.lit("late").alias("x"))).alias("rare")))
    study = F.when(F.col("o_orderkey") % 100 == 3, F.regexp_replace(study, '"total":[^,}]*', '"total":"unknown"')).otherwise(study)
    path = _fresh(spark, "q37")
    pages = o.groupBy(F.expr("o_orderkey div 1000")).agg(F.array_join(F.collect_list(study), ",\n").alias("s"))
    pages.select(F.concat(F.lit('{\n"studies": [\n'), "s", F.lit('\n],\n"nextPageToken": "t"\n}\n'))).write.option(
        "maxRecordsPerFile", 1).option("compression", "gzip").text(f"{path}/text")
    sheet = [Entry("id", "id"), Entry("status", "info.status"), Entry("total", "info.total", "double"),
             Entry("first_tag", "tags[0].name"), Entry("rare", "rare.x"), Entry("missing", "info.nothing")]
    reader = registry.page_texts(spark.read.option("multiLine", True), "source_file", "fail",
                                 lambda r: r.option("pathGlobFilter", "*.gz").json(f"{path}/text"))
    s = registry.parse_pages(reader, declared_study(sheet), "source_file", "unparsed")
    f = flatten(s, {e.variable: e.path for e in sheet}, keep=("unparsed",))
    return f.withColumn("total", r4("total")).withColumn("misfits", F.col("unparsed").isNotNull().cast("long")).drop("unparsed")


@query("q38_sinks", """
SELECT kind, c_mktsegment AS segment, count(*) AS n, round(sum(round(CAST(c_acctbal AS DOUBLE), 2)), 2) AS balance
FROM customer, (SELECT unnest(['csv', 'json', 'parquet', 'sheet', 'led']) AS kind) GROUP BY kind, c_mktsegment
""")
def q38(spark, sf):
    """Every sink written and read back; one sheet has three lead
    lines above its header in every file."""
    c = T(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"))
    base = _fresh(spark, "q38")
    registry.write_parquet(c, f"{base}/parquet", partition_by=["c_mktsegment"])
    registry.write_csv(c, f"{base}/csv")
    registry.write_json(c, f"{base}/json", digits=2)
    rows = c.select(F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), "c_mktsegment", F.lit('"')), "c_acctbal").alias("line"),
                    F.expr("c_custkey div 1000").alias("part"))
    lead = F.lit("Planning sheet,,\n,,\nas of,2001-01-01,\nc_custkey,c_mktsegment, c_acctbal \n")
    (rows.groupBy("part").agg(F.concat(lead, F.array_join(F.collect_list("line"), "\n")).alias("value")).select("value")
     .write.option("maxRecordsPerFile", 1).text(f"{base}/led"))
    back = {"parquet": spark.read.parquet(f"{base}/parquet"), "csv": spark.read.option("header", True).csv(f"{base}/csv"),
            "json": spark.read.schema(c.schema).json(f"{base}/json"), "sheet": registry.read_planning_sheet(spark, f"{base}/csv"),
            "led": registry.read_planning_sheet(spark, f"{base}/led", required=["c_custkey", "c_acctbal"])}
    blocks = [(k, d.select(F.col("c_mktsegment").cast("string").alias("segment"), F.col("c_acctbal").cast("double").alias("b")))
              for k, d in back.items()]
    return reports.concat_blocks(blocks, "kind").groupBy("kind", "segment").agg(
        F.count("*").alias("n"), F.round(F.sum("b"), 2).alias("balance"))


@query("q39_guards", """
SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_type END, 'Unknown') AS p_kind, p_size AS p_size,
       CAST(NULL AS DOUBLE) AS dropout_rate, 'gone,nowhere' AS absent
FROM part WHERE p_size % 3 <> 0
""")
def q39(spark, sf):
    """Padded names, a renamed variant, an absent optional
    column, requested columns that are missing, null rows and fills."""
    p = T(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_type")).alias(" Kind "),
                                    F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("p_size"))
    p = cohort.ensure_columns(cohort.strip_names(p), {"dropout_rate": "double"}, required=("p_partkey",),
                              renames={"Kind": "p_kind"})
    have, absent = cohort.select_present(p, [*cohort.prefixed(p, "p_"), "gone", "dropout_rate", "nowhere"])
    full = cohort.fill_constants(cohort.drop_null_rows(have, ["p_size"]), {"p_kind": "Unknown"})
    return full.withColumn("absent", F.lit(",".join(absent)))


@query("q40_summary_order", """
WITH s AS (SELECT o_orderstatus AS study, o_orderpriority AS model, avg(o_totalprice) AS mae_mean,
                  CAST(o_orderpriority = '5-LOW' AS BIGINT) AS is_baseline FROM orders GROUP BY 1, 2, 4)
SELECT study, model, round(mae_mean, 4) AS mae_mean, is_baseline,
       row_number() OVER (ORDER BY study, is_baseline DESC, mae_mean DESC) AS position FROM s
""")
def q40(spark, sf):
    """Baselines first within a study, then the metric descending, with
    the place as a column."""
    s = T(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("study"), F.col("o_orderpriority").alias("model")).agg(
        F.avg("o_totalprice").alias("mae_mean"))
    s = s.withColumn("is_baseline", (F.col("model") == "5-LOW").cast("long"))
    r = reports.sort_summary(s, "mae_mean", "is_baseline", "study", position="position")
    return r.withColumn("mae_mean", r4("mae_mean"))


@query("q41_summary_texts", """
SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def q41(spark, sf):
    """T1x: id and text of the listed ids."""
    ids = T(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    t = embed.summary_table(T(spark, sf, "documents"), "doc_id", "text", ids)
    return t.select("doc_id", F.md5("text").alias("text_md5"))


@query("q42_labels", r"""
WITH p AS (SELECT p_partkey, p_size, replace(p_name, ' ', '_') AS name, p_size % 7 = 0 AS base FROM part),
l AS (SELECT DISTINCT name, 'Part ' || upper(name) AS label FROM p WHERE p_size > 25)
SELECT p_partkey, coalesce(label, upper(substr(replace(trim(regexp_replace(p.name, '[_\s]+', ' ', 'g')), ' ts', ''), 1, 1))
         || substr(replace(trim(regexp_replace(p.name, '[_\s]+', ' ', 'g')), ' ts', ''), 2)) AS label,
       CASE WHEN base THEN 'Used' ELSE 'all - ' || p.name END AS clean
FROM p LEFT JOIN l ON p.name = l.name
""")
def q42(spark, sf):
    """dictionary labels with the tidy fallback; tail of study labels and
    the baseline's own label."""
    p = T(spark, sf, "part").select("p_partkey", "p_size", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
                                    (F.col("p_size") % 7 == 0).cast("int").alias("base"))
    names = p.where("p_size > 25").select("name", F.concat(F.lit("Part "), F.upper("name")).alias("label")).distinct()
    full = F.concat(F.lit("Raw | all - "), F.col("name"))
    return harmonise.pretty_labels(p, "name", names).select(
        "p_partkey", "label", harmonise.relabel_baseline(full, "base", "Used").alias("clean"))


_PROFILE = ("l_quantity", "l_extendedprice", "l_discount")


@query("q43_profile_numeric", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
       round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
       round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM lineitem""" for c in _PROFILE))
def q43(spark, sf):
    """A10: describe part of the table profile."""
    r = reports.profile_numeric(T(spark, sf, "lineitem"), _PROFILE)
    return r.select("column_name", "count", *[r4(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("q44_onehot", """
SELECT 'prio_ohe_' || coalesce(p, '3-MEDIUM') AS slot, count(*) AS n
FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders),
     (SELECT p AS m FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders)
      WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)
GROUP BY 1
""".replace("coalesce(p, '3-MEDIUM')", "coalesce(p, m)"))
def q44(spark, sf):
    """M2, M3: mode imputation, one-hot slots and their names, counted."""
    o = T(spark, sf, "orders").select(
        F.col("o_totalprice").cast("double").alias("price"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("prio"))
    prep = model.ImputeScale(["price"], ["prio"], index=False).fit(o).transform(o)
    design = model.design_pipeline(["price"], ["prio"]).fit(prep).transform(prep)
    names = model.feature_names(design)
    slots = design.select(F.posexplode(vector_to_array("features")).alias("i", "v")).where("v = 1 AND i > 0")
    counted = slots.groupBy("i").agg(F.count("*").alias("n"))
    return counted.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("slot"), "n")


@query("q34b_blocks", None)
def q34b(spark, sf):
    """F36 by matching blocks: every part's name, with words turned, letters
    lost and added, against the canonical names (tested against brute force)."""
    vals, canon, syn = _q34_inputs(spark, sf)
    h = harmonise.harmonise(vals, "value", canon, syn, threshold=0.70)
    return h.select("p_partkey", "value", "match", r4("confidence").alias("confidence"), "reason")
