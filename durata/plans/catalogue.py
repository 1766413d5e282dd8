"""Query catalogue on the driver tables.

The driver tables hold no trials, so every operator is called with column
names of these tables.  Each ``qNN`` function takes (spark, sf_dir) and
returns a DataFrame; ``ORACLE[name]`` is the same computation in DuckDB SQL.
Doubles are rounded to 4 places and integers are bigint on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as TX
from ..operators import classify, cohort, harmonise, novelty, reports, split, vectors
from ..operators.flatten import flatten
from ..operators.quantile import QuantileUniform
from ..sources import idlists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def r4(c) -> F.Column:
    return F.round(R._c(c).cast("double"), 4)


def sql_case(col: str, mapping: dict, default: str = "NULL") -> str:
    def q(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {col} {arms} ELSE {default} END"


def spark_case(col, mapping: dict) -> F.Column:
    return R.map_values(col, {k: v for k, v in mapping.items() if v is not None})


def _order_dates(spark, sf):
    """orders with start = order date and completion = last ship date."""
    o = T(spark, sf, "orders")
    li = (T(spark, sf, "lineitem").groupBy("l_orderkey")
          .agg(F.max(F.to_date("l_shipdate")).alias("complete"),
               F.sum("l_quantity").alias("patients"),
               F.min(F.to_date("l_shipdate")).alias("first_ship")))
    return o.join(li, o.o_orderkey == li.l_orderkey, "inner").withColumn("start", F.to_date("o_orderdate"))


_ORDER_DATES_SQL = """
  l AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS complete, sum(l_quantity) AS patients,
               min(CAST(l_shipdate AS DATE)) AS first_ship
        FROM lineitem GROUP BY l_orderkey),
  od AS (SELECT o.*, CAST(o_orderdate AS DATE) AS start, complete, patients, first_ship
         FROM orders o JOIN l ON l_orderkey = o_orderkey)"""

# ---------------------------------------------------------------------------
# q01 cohort filter
# ---------------------------------------------------------------------------

AS_OF = "2001-06-30"


@query("q01_cohort", f"""
WITH {_ORDER_DATES_SQL}
SELECT o_orderkey, CAST(start AS VARCHAR) AS start_date, CAST(complete AS VARCHAR) AS complete_date,
       CAST(date_diff('day', start, complete) AS BIGINT) AS duration_days, round(patients, 4) AS patients
FROM od
WHERE start >= DATE '1996-01-01' AND complete IS NOT NULL AND complete <= DATE '{AS_OF}'
  AND upper(trim(o_orderstatus)) IN ('F', 'O')
  AND date_diff('day', start, complete) BETWEEN 30 AND 3650 AND patients IS NOT NULL AND patients >= 10
""")
def q01(spark, sf):
    d = _order_dates(spark, sf)
    d = cohort.cohort_filter(d, "start", "complete", AS_OF, "1996-01-01",
                             status_col="o_orderstatus", statuses=("F", "O"))
    d = d.withColumn("duration_days", R.day_diff("complete", "start").cast("long"))
    d = cohort.post_filter(d, "duration_days", "patients", 30, 3650, 10)
    return d.select("o_orderkey", F.col("start").cast("string").alias("start_date"),
                    F.col("complete").cast("string").alias("complete_date"), "duration_days",
                    r4("patients").alias("patients"))


# ---------------------------------------------------------------------------
# q02 numeric coerce
# ---------------------------------------------------------------------------

@query("q02_numeric", """
SELECT event_id, event_type,
       round(TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE), 4) AS k_num,
       round(TRY_CAST(trim(event_type) AS DOUBLE), 4) AS type_num
FROM events
""")
def q02(spark, sf):
    e = T(spark, sf, "events")
    return e.select("event_id", "event_type",
                    r4(cohort.numeric(F.get_json_object("props", "$.k"))).alias("k_num"),
                    r4(cohort.numeric("event_type")).alias("type_num"))


# ---------------------------------------------------------------------------
# q03/q04 nested paths and path pairs
# ---------------------------------------------------------------------------

def _studies(spark, sf):
    li = T(spark, sf, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("line"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship"),
        F.col("l_quantity").alias("qty"), F.col("l_partkey").alias("part")))).alias("lines"))
    o = T(spark, sf, "orders")
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    study = F.struct(
        F.struct(F.col("o_orderkey").alias("key"), d.alias("date"), F.substring(d, 1, 7).alias("month"),
                 F.concat(d, F.lit("T08:00:00")).alias("stamp"),
                 F.col("o_orderpriority").alias("priority")).alias("order"),
        F.col("lines"))
    return (o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
            .select("o_orderkey", study.alias("s")).select("o_orderkey", "s.*"))


Q03_MAP = {
    "priority": "order.priority",
    "first_qty": "lines[0].qty",
    "last_ship": "lines[-1].ship",
    "sixth_qty": "lines[5].qty",
    "third_last_line": "lines[-3].line",
    "through_array": "lines.qty",
    "missing_field": "order.nothing",
    "three_paths": "order.date | lines[0].ship | lines[1].ship",
}


@query("q03_paths", """
WITH l AS (SELECT l_orderkey, list(struct_pack(line := l_linenumber, qty := l_quantity,
                  ship := strftime(l_shipdate, '%Y-%m-%d')) ORDER BY l_linenumber, l_shipdate, l_quantity, l_partkey) AS lines
           FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_orderpriority AS priority, round(lines[1].qty, 4) AS first_qty,
       lines[-1].ship AS last_ship, round(lines[6].qty, 4) AS sixth_qty,
       CAST(lines[-3].line AS BIGINT) AS third_last_line, CAST(NULL AS VARCHAR) AS through_array,
       CAST(NULL AS VARCHAR) AS missing_field, CAST(NULL AS BIGINT) AS three_paths
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
""")
def q03(spark, sf):
    f = flatten(_studies(spark, sf), Q03_MAP, ["o_orderkey"])
    return f.select("o_orderkey", "priority", r4("first_qty").alias("first_qty"), "last_ship",
                    r4("sixth_qty").alias("sixth_qty"),
                    F.col("third_last_line").cast("long").alias("third_last_line"),
                    F.col("through_array").cast("string").alias("through_array"),
                    F.col("missing_field").cast("string").alias("missing_field"),
                    F.col("three_paths").cast("long").alias("three_paths"))


Q04_MAP = {
    "d_full": "order.date | lines[-1].ship",
    "d_partial": "order.month | lines[-1].ship",
    "d_stamp": "order.stamp | lines[0].ship",
}


@query("q04_path_pairs", """
WITH l AS (SELECT l_orderkey, list(strftime(l_shipdate, '%Y-%m-%d') ORDER BY l_linenumber, l_shipdate, l_quantity, l_partkey) AS ships
           FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(ships[-1] AS DATE)) AS BIGINT) AS d_full,
       CAST(NULL AS BIGINT) AS d_partial,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(ships[1] AS DATE)) AS BIGINT) AS d_stamp
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
""")
def q04(spark, sf):
    return flatten(_studies(spark, sf), Q04_MAP, ["o_orderkey"])


# ---------------------------------------------------------------------------
# q05 lenient dates
# ---------------------------------------------------------------------------

@query("q05_dates", """
WITH s AS (
  SELECT o_orderkey, CASE o_orderpriority
      WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN '2-HIGH' THEN strftime(o_orderdate, '%B %Y')
      WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%B %-d, %Y')
      WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m')
      ELSE strftime(o_orderdate, '%Y') END AS raw
  FROM orders),
p AS (SELECT *, coalesce(TRY_CAST(raw AS DATE), CAST(try_strptime(raw, '%B %-d, %Y') AS DATE),
               CAST(try_strptime(raw, '%B %Y') AS DATE), CAST(try_strptime(raw, '%Y-%m') AS DATE),
               CAST(try_strptime(raw, '%Y') AS DATE)) AS d FROM s)
SELECT o_orderkey, raw, CAST(d AS VARCHAR) AS parsed, CAST(year(d) AS BIGINT) AS start_year,
       CAST(CAST(CASE WHEN o_orderkey % 6 = 1 THEN date_trunc('year', o_orderdate) ELSE o_orderdate END AS DATE) AS VARCHAR)
         AS soup, CAST(NULL AS VARCHAR) AS bad
FROM p JOIN orders USING (o_orderkey)
""")
def q05(spark, sf):
    o = T(spark, sf, "orders")
    d = F.col("o_orderdate")
    raw = (F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyy-MM-dd"))
           .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "MMMM yyyy"))
           .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "MMMM d, yyyy"))
           .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(d, "yyyy-MM"))
           .otherwise(F.date_format(d, "yyyy")))
    key, f = F.col("o_orderkey") % 6, lambda pattern: F.date_format(d, pattern)
    soup = (F.when(key == 0, F.concat(F.lit("Completed: "), f("MMMM d, yyyy"), F.lit(" (actual)")))
            .when(key == 1, F.concat(F.lit("about "), f("yyyy")))
            .when(key == 2, F.concat(f("d"), F.lit("th of "), f("MMM"), F.lit(" "), f("yyyy")))
            .when(key == 3, F.concat(f("M/d/yyyy"), F.lit(" at 10:30")))
            .when(key == 4, f("yyyyMMdd")).otherwise(F.concat(F.lit("est. "), f("d-MMM-yy"))))
    p = o.select("o_orderkey", raw.alias("raw"), soup.alias("s"), F.concat(F.lit("99/99/"), f("yyyy")).alias("b"))
    p = p.withColumn("d", R.parse_date_any("raw"))
    return p.select("o_orderkey", "raw", F.col("d").cast("string").alias("parsed"),
                    F.year("d").cast("long").alias("start_year"), R.parse_date_any("s").cast("string").alias("soup"),
                    R.parse_date_any("b").cast("string").alias("bad"))


# ---------------------------------------------------------------------------
# q06 list / pipe counts
# ---------------------------------------------------------------------------

def _nb(s):  # non-blank pipe parts (DuckDB)
    return f"list_filter(string_split({s}, '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')"


def _count_any_sql(s):
    nb = _nb(s)
    return (f"CASE WHEN {s} IS NULL THEN NULL WHEN len({nb}) = 1 AND regexp_full_match({nb}[1], '[0-9]+') "
            f"THEN CAST({nb}[1] AS BIGINT) ELSE CAST(len({nb}) AS BIGINT) END")


def _list_len_sql(s):
    return f"CAST(len(list_filter(string_split({s}, '|'), lambda x: x <> '')) AS BIGINT)"


@query("q06_counts", f"""
WITH s AS (SELECT p_partkey, p_name, replace(p_name, ' ', '|') AS s1,
                  replace(p_name, ' ', '|') || '|| |' || CAST(p_size AS VARCHAR) AS s2,
                  CAST(p_size AS VARCHAR) AS s3, ' ' || CAST(p_size AS VARCHAR) || ' ' AS s4
           FROM part)
SELECT p_partkey, {_list_len_sql('s1')} AS len_s1, {_list_len_sql('s2')} AS len_s2,
       {_count_any_sql('s2')} AS any_s2, {_count_any_sql('s3')} AS any_s3, {_count_any_sql('s4')} AS any_s4,
       CAST(len(string_split(p_name, ' ')) AS BIGINT) AS arr_len,
       coalesce({_count_any_sql('s2')}, 0) AS primary_out_n,
       coalesce({_count_any_sql('s3')}, 0) AS secondary_out_n,
       CAST(0 AS BIGINT) AS other_out_n,
       coalesce({_count_any_sql('s2')}, 0) + coalesce({_count_any_sql('s3')}, 0) AS assessments_n
FROM s
""")
def q06(spark, sf):
    p = T(spark, sf, "part")
    s1 = F.regexp_replace("p_name", " ", "|")
    s2 = F.concat(s1, F.lit("|| |"), F.col("p_size").cast("string"))
    s3 = F.col("p_size").cast("string")
    s4 = F.concat(F.lit(" "), s3, F.lit(" "))
    prim = F.coalesce(R.count_any(s2), F.lit(0))
    sec = F.coalesce(R.count_any(s3), F.lit(0))
    oth = F.coalesce(R.count_any(F.lit(None).cast("string")), F.lit(0))
    return p.select("p_partkey", R.list_len(s1).alias("len_s1"), R.list_len(s2).alias("len_s2"),
                    R.count_any(s2).alias("any_s2"), R.count_any(s3).alias("any_s3"),
                    R.count_any(s4).alias("any_s4"),
                    R.count_any(F.split("p_name", " "), is_array=True).alias("arr_len"),
                    prim.cast("long").alias("primary_out_n"), sec.cast("long").alias("secondary_out_n"),
                    oth.cast("long").alias("other_out_n"),
                    (prim + sec + oth).cast("long").alias("assessments_n"))


# ---------------------------------------------------------------------------
# q07 complexity buckets
# ---------------------------------------------------------------------------

@query("q07_buckets", """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CAST(n AS BIGINT) AS n_lines,
       CASE WHEN n IS NULL THEN NULL WHEN n <= 3 THEN 'Low' WHEN n <= 6 THEN 'Medium' ELSE 'High' END AS bucket
FROM orders LEFT JOIN n ON l_orderkey = o_orderkey
""")
def q07(spark, sf):
    n = T(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    o = T(spark, sf, "orders")
    j = o.join(n, o.o_orderkey == n.l_orderkey, "left")
    return j.select("o_orderkey", F.col("n_lines").cast("long"), R.complexity_bucket("n_lines").alias("bucket"))


# ---------------------------------------------------------------------------
# q08 bullets / paragraphs
# ---------------------------------------------------------------------------

def _strip_sql(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _elig_sql(t):
    bullets = f"len(regexp_extract_all({t}, '(?m)^[ \\t]*[•*\\-][ \\t]+'))"
    paras = (f"len(list_filter(string_split_regex({t}, '\\n\\s*\\n'), "
             f"lambda p: {_strip_sql('p')} <> ''))")
    return (f"CASE WHEN {t} IS NULL OR {_strip_sql(t)} = '' THEN NULL "
            f"WHEN {bullets} > 0 THEN CAST({bullets} AS DOUBLE) ELSE CAST({paras} AS DOUBLE) END")


@query("q08_criteria", f"""
SELECT 'page' AS src, page_id AS id,
       {_elig_sql("regexp_replace(html, '<li[^>]*>', chr(10) || '* ', 'g')")} AS n_items
FROM pages
UNION ALL
SELECT 'doc' AS src, doc_id AS id, {_elig_sql('text')} AS n_items FROM documents
""")
def q08(spark, sf):
    pg = T(spark, sf, "pages").select(
        F.lit("page").alias("src"), F.col("page_id").alias("id"),
        R.n_elig_criteria(F.regexp_replace("html", "<li[^>]*>", "\n* ")).alias("n_items"))
    dc = T(spark, sf, "documents").select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"), R.n_elig_criteria("text").alias("n_items"))
    return pg.unionByName(dc)


# ---------------------------------------------------------------------------
# q09 ordered pattern classification
# ---------------------------------------------------------------------------

# Words of part names mapped to condition words (query input, not a rule).
Q09_FIRST = {"red": "Breast", "small": "Lung", "hot": "Heart", "large": "Type 2",
             "old": "Chronic Kidney", "blue": "Major Depressive", "cold": "Pediatric",
             "new": "Sjögren", "green": "Childhood", "big": "Rheumatoid"}
Q09_SECOND = {"widget": "Cancer", "plate": "Failure", "ring": "Diabetes", "rod": "Disease",
              "gear": "Disorder", "bolt": "Asthma", "gizmo": "Carcinoma", "anvil": "Syndrome"}


def _ta_sql(t):
    norm = (f"trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")
    arms = " ".join(f"WHEN regexp_matches({norm}, '(?i){p}') THEN '{lab}'"
                    for p, lab in classify.THERAPEUTIC_AREAS)
    return f"CASE WHEN {t} IS NULL OR {t} = '' THEN 'Other' {arms} ELSE 'Other' END"


def _q09_cond_sql():
    w1 = "split_part(p_name, ' ', 1)"
    w2 = "split_part(p_name, ' ', 2)"
    return (f"coalesce({sql_case(w1, Q09_FIRST)}, {w1}) || ' ' || coalesce({sql_case(w2, Q09_SECOND)}, {w2})"
            " || '|' || p_type")


@query("q09_classify", f"""
WITH c AS (SELECT p_partkey, {_q09_cond_sql()} AS raw FROM part),
t AS (SELECT p_partkey, split_part(raw, '|', 1) AS condition_top FROM c)
SELECT p_partkey, condition_top, {_ta_sql('condition_top')} AS therapeutic_area FROM t
""")
def q09(spark, sf):
    p = T(spark, sf, "part")
    w = F.split("p_name", " ")
    w1, w2 = F.get(w, 0), F.get(w, 1)
    cond = F.concat(F.coalesce(spark_case(w1, Q09_FIRST), w1), F.lit(" "),
                    F.coalesce(spark_case(w2, Q09_SECOND), w2), F.lit("|"), F.col("p_type"))
    d = p.select("p_partkey", R.first_token(cond).alias("condition_top"))
    return classify.first_match(d, "condition_top", out="therapeutic_area")


# ---------------------------------------------------------------------------
# q10 ages, windows (F10 F24) and q16 population class
# ---------------------------------------------------------------------------

Q10_UNIT = {"STANDARD": " Years", "SMALL": " Months", "MEDIUM": " weeks", "LARGE": " Days",
            "ECONOMY": "", "PROMO": " Hours"}
Q16_POP = {"STANDARD": "Adult", "SMALL": "adult, child", "MEDIUM": "pediatric", "LARGE": "x",
           "PROMO": "Both"}


def _age_sql(s):
    st = f"lower({_strip_sql(s)})"
    num = f"regexp_extract({st}, '(\\d+\\.?\\d*)', 1)"
    unit = f"regexp_extract({st}, '(?i)(year|month|week|day)s?', 1)"
    v = f"TRY_CAST({num} AS DOUBLE)"
    return (f"CASE WHEN {s} IS NULL OR {st} = '' OR starts_with({st}, 'n/a') OR {num} = '' THEN NULL "
            f"WHEN starts_with({unit}, 'month') THEN {v} / 12.0 WHEN starts_with({unit}, 'week') THEN {v} / 52.0 "
            f"WHEN starts_with({unit}, 'day') THEN {v} / 365.0 ELSE {v} END")


_Q10_AGES_SQL = f"""
  raw AS (SELECT p_partkey, p_type,
            CASE WHEN p_brand = 'Brand#1' THEN 'N/A (No limit)'
                 ELSE CAST(p_size AS VARCHAR) || {sql_case('p_type', Q10_UNIT, "''")} END AS min_raw,
            CAST(CAST(floor(p_retailprice) AS BIGINT) % 60 AS VARCHAR) || ' Years' AS max_raw
          FROM part),
  a0 AS (SELECT p_partkey, p_type, nullif({_age_sql('min_raw')}, 0) AS lo0, nullif({_age_sql('max_raw')}, 0) AS hi0
         FROM raw),
  a AS (SELECT p_partkey, p_type,
          CASE WHEN lo0 IS NOT NULL AND hi0 IS NOT NULL AND lo0 > hi0 THEN hi0 ELSE lo0 END AS age_min,
          CASE WHEN lo0 IS NOT NULL AND hi0 IS NOT NULL AND lo0 > hi0 THEN lo0 ELSE hi0 END AS age_max
        FROM a0)"""


def _ages(spark, sf):
    p = T(spark, sf, "part")
    unit = F.coalesce(spark_case("p_type", Q10_UNIT), F.lit(""))
    min_raw = F.when(F.col("p_brand") == "Brand#1", F.lit("N/A (No limit)")) \
        .otherwise(F.concat(F.col("p_size").cast("string"), unit))
    max_raw = F.concat((F.floor("p_retailprice").cast("long") % 60).cast("string"), F.lit(" Years"))
    y = p.select("p_partkey", "p_type", R.age_to_years(min_raw).alias("__lo"), R.age_to_years(max_raw).alias("__hi"))
    lo, hi, rng = R.age_window("__lo", "__hi")
    return y.select("p_partkey", "p_type", lo.alias("age_min"), hi.alias("age_max"), rng.alias("age_range"))


@query("q10_ages", f"""
WITH {_Q10_AGES_SQL}
SELECT p_partkey, round(age_min, 4) AS age_min, round(age_max, 4) AS age_max,
       round(age_max - age_min, 4) AS age_range FROM a
""")
def q10(spark, sf):
    a = _ages(spark, sf)
    return a.select("p_partkey", r4("age_min").alias("age_min"), r4("age_max").alias("age_max"),
                    r4("age_range").alias("age_range"))


def _pop_sql(t):
    s = f"lower(coalesce({t}, 'None'))"
    adult = f"regexp_matches({s}, '\\badult\\b')"
    child = f"regexp_matches({s}, '\\b(?:child|p(?:a|e)diat|peds?)\\b')"
    mixed = f"(regexp_matches({s}, '\\b(?:both|mixed)\\b') OR ({adult} AND {child}))"
    return (f"CASE WHEN {mixed} THEN 'Mixed' WHEN {adult} THEN 'Adult' WHEN {child} THEN 'Pediatric' "
            "WHEN age_min IS NOT NULL AND age_max IS NOT NULL AND age_min < 18 AND age_max >= 18 THEN 'Mixed' "
            "WHEN age_min IS NOT NULL AND age_min >= 18 THEN 'Adult' "
            "WHEN age_max IS NOT NULL AND age_max < 18 THEN 'Pediatric' ELSE 'Unknown' END")


@query("q16_population", f"""
WITH {_Q10_AGES_SQL},
  t AS (SELECT *, {sql_case('p_type', Q16_POP)} AS pop FROM a)
SELECT p_partkey, {_pop_sql('pop')} AS population_class FROM t
""")
def q16(spark, sf):
    a = _ages(spark, sf).withColumn("pop", spark_case("p_type", Q16_POP))
    return a.select("p_partkey", R.population_class("pop", "age_min", "age_max").alias("population_class"))


# ---------------------------------------------------------------------------
# q11 sites and countries
# ---------------------------------------------------------------------------

@query("q11_sites", """
WITH s AS (SELECT l_orderkey, count(*) AS site_n,
                  count(DISTINCT CASE WHEN n_name <> '' THEN n_name END) AS country_n,
                  sum(l_quantity) AS patients
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
           GROUP BY l_orderkey)
SELECT o_orderkey, CAST(coalesce(site_n, 0) AS BIGINT) AS site_n, CAST(coalesce(country_n, 0) AS BIGINT) AS country_n,
       round(patients / nullif(site_n, 0), 4) AS patients_per_site,
       CASE WHEN coalesce(country_n, 0) > 1 THEN 'Global' ELSE 'Single' END AS global_trial
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey
""")
def q11(spark, sf):
    li, su, na = T(spark, sf, "lineitem"), T(spark, sf, "supplier"), T(spark, sf, "nation")
    sites = (li.join(su, li.l_suppkey == su.s_suppkey).join(na, su.s_nationkey == na.n_nationkey)
             .groupBy("l_orderkey")
             .agg(F.collect_list(F.struct(F.col("l_linenumber").alias("site"),
                                          F.col("n_name").alias("country"))).alias("sites"),
                  F.sum("l_quantity").alias("patients")))
    o = T(spark, sf, "orders")
    j = o.join(sites, o.o_orderkey == sites.l_orderkey, "left")
    j = j.withColumn("site_n", R.count_sites("sites")).withColumn("country_n", R.count_unique_countries("sites"))
    return j.select("o_orderkey", "site_n", "country_n",
                    r4(R.patients_per_site("patients", "site_n")).alias("patients_per_site"),
                    R.global_trial("country_n").alias("global_trial"))


# ---------------------------------------------------------------------------
# q12 dictionaries with ordinals
# ---------------------------------------------------------------------------

Q12_PHASE = {"1-URGENT": "phase1", "2-HIGH": "PHASE2/PHASE3", "3-MEDIUM": "EARLY PHASE 1",
             "4-NOT SPECIFIED": "EARLY_PHASE1"}
Q12_ALLOC = {"F": " Randomized ", "O": "NON_RANDOMIZED", "P": "non-randomised"}
Q12_MASK = {"1-URGENT": "Double", "2-HIGH": "None (Open Label)", "3-MEDIUM": "quadruple",
            "4-NOT SPECIFIED": "foo"}


def _phase_sql(t):
    m = {k: v for k, v in R.PHASE_MAP.items()}
    return f"coalesce({sql_case(f'upper(coalesce({t}, chr(0)))', m)}, 'Unknown')"


def _ordinal_sql(t, levels):
    arms = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(levels))
    return f"CAST(CASE {t} {arms} END AS BIGINT)"


def _mask_sql(t):
    kw = f"lower(regexp_extract(coalesce({t}, 'None'), '(?i)({R.MASKING_KEYWORDS})', 1))"
    return f"coalesce({sql_case(kw, R.MASKING_MAP)}, 'Other')"


@query("q12_maps", f"""
WITH r AS (SELECT o_orderkey, {sql_case('o_orderpriority', Q12_PHASE)} AS phase_raw,
                  {sql_case('o_orderstatus', Q12_ALLOC)} AS alloc_raw,
                  {sql_case('o_orderpriority', Q12_MASK)} AS mask_raw FROM orders),
m AS (SELECT o_orderkey, {_phase_sql('phase_raw')} AS phase,
             coalesce({sql_case(f"upper({_strip_sql('coalesce(alloc_raw, ' + chr(39) + 'None' + chr(39) + ')')})", R.ALLOCATION_MAP)}, 'Unknown') AS allocation,
             {_mask_sql('mask_raw')} AS masking_level FROM r)
SELECT o_orderkey, phase, {_ordinal_sql('phase', R.PHASE_LEVELS)} AS phase_ord, allocation,
       CAST(allocation = 'Randomized' AS BIGINT) AS randomized_flag, masking_level,
       CAST(masking_level IN ('Single', 'Double', 'Triple', 'Quadruple') AS BIGINT) AS masking_flag
FROM m
""")
def q12(spark, sf):
    o = T(spark, sf, "orders")
    d = o.select("o_orderkey",
                 R.phase_label(spark_case("o_orderpriority", Q12_PHASE)).alias("phase"),
                 R.allocation(spark_case("o_orderstatus", Q12_ALLOC)).alias("allocation"),
                 R.masking_level(spark_case("o_orderpriority", Q12_MASK)).alias("masking_level"))
    return d.select("o_orderkey", "phase", R.ordinal("phase", R.PHASE_LEVELS).cast("long").alias("phase_ord"),
                    "allocation", R.randomized_flag("allocation").cast("long").alias("randomized_flag"),
                    "masking_level", R.masking_flag("masking_level").cast("long").alias("masking_flag"))


# ---------------------------------------------------------------------------
# q13 first token, sponsor rule, title case
# ---------------------------------------------------------------------------

Q13_SPONSOR = {"STANDARD": "University", "SMALL": "NIH Clinical Center", "LARGE": "City HOSPITAL",
               "ECONOMY": "Pharma Inc", "MEDIUM": "Pharma Inc"}


def _title_sql(s):
    chars = f"string_split({s}, '')"
    return (f"CASE WHEN {s} IS NULL THEN NULL ELSE array_to_string(list_transform({chars}, lambda c, i: "
            f"CASE WHEN i = 1 OR NOT regexp_matches({chars}[i - 1], '^\\p{{L}}$') THEN upper(c) ELSE lower(c) END), '') END")


@query("q13_tokens", f"""
WITH s AS (SELECT p_partkey, p_type || '|' || p_name AS cond_raw,
                  p_name || ' ' || {sql_case('p_type', Q13_SPONSOR)} AS sponsor,
                  lower(p_brand) || '|' || p_type AS admin_raw,
                  {_strip_sql("'  ' || p_name || '-' || lower(p_type) || ' '")} AS st_raw
           FROM part)
SELECT p_partkey, split_part(cond_raw, '|', 1) AS condition_top,
       CASE WHEN coalesce(regexp_matches(sponsor, '(?i){R.SPONSOR_ACADEMIC}'), false) THEN 'Academic' ELSE 'Industry' END
         AS sponsor_class,
       split_part(admin_raw, '|', 1) AS intervention_type,
       nullif({_title_sql('st_raw')}, '') AS study_type
FROM s
""")
def q13(spark, sf):
    p = T(spark, sf, "part")
    sponsor = F.concat(F.col("p_name"), F.lit(" "), spark_case("p_type", Q13_SPONSOR))
    st_raw = F.concat(F.lit("  "), F.col("p_name"), F.lit("-"), F.lower("p_type"), F.lit(" "))
    return p.select("p_partkey",
                    R.first_token(F.concat_ws("|", "p_type", "p_name")).alias("condition_top"),
                    R.sponsor_class(sponsor).alias("sponsor_class"),
                    R.first_token(F.concat_ws("|", F.lower("p_brand"), "p_type")).alias("intervention_type"),
                    R.study_type(st_raw).alias("study_type"))


# ---------------------------------------------------------------------------
# q14 leftmost keyword, flags
# ---------------------------------------------------------------------------

Q14_MASK = {"STANDARD": "Double (Participant, Investigator)", "SMALL": "None (Open Label)",
            "LARGE": "quadruple blind; single site", "PROMO": "foo", "ECONOMY": "Triple"}
Q14_COHORT = {"STANDARD": "Sequential cohorts", "SMALL": "parallel", "LARGE": "SEQ/PAR", "PROMO": "n/a"}


def _flag_sql(t, pat):
    return f"CAST(coalesce(regexp_matches(coalesce({t}, 'None'), '(?i){pat}'), false) AS BIGINT)"


@query("q14_flags", f"""
WITH s AS (SELECT p_partkey, {sql_case('p_type', Q14_MASK)} AS mask_raw,
                  p_name || ' ' || CAST(p_size AS VARCHAR) AS placebo_raw,
                  {sql_case('p_type', Q14_COHORT)} AS cohort_raw,
                  CASE WHEN p_size > 40 THEN NULL WHEN p_size > 25 THEN 'TRUE' ELSE 'false' END AS safety_raw,
                  p_brand AS drug_raw,
                  CASE WHEN p_type = 'SMALL' THEN 'Yes' ELSE 'No' END AS device_raw
           FROM part),
m AS (SELECT *, {_mask_sql('mask_raw')} AS masking_level FROM s)
SELECT p_partkey, masking_level,
       CAST(masking_level IN ('Single', 'Double', 'Triple', 'Quadruple') AS BIGINT) AS masking_flag,
       {_flag_sql('placebo_raw', R.YES_PATTERN)} AS placebo_flag,
       CASE WHEN contains(lower(coalesce(cohort_raw, 'None')), 'seq') THEN 'Sequential'
            WHEN contains(lower(coalesce(cohort_raw, 'None')), 'par') THEN 'Parallel' ELSE 'Other' END AS cohort_design,
       {_flag_sql('safety_raw', R.SAFETY_PATTERN)} AS safety_cuts_flag,
       {_flag_sql('drug_raw', R.YES_PATTERN)} AS fda_drug_flag,
       {_flag_sql('device_raw', R.YES_PATTERN)} AS fda_device_flag
FROM m
""")
def q14(spark, sf):
    p = T(spark, sf, "part")
    safety = F.when(F.col("p_size") > 40, F.lit(None).cast("string")) \
        .when(F.col("p_size") > 25, "TRUE").otherwise("false")
    lvl = R.masking_level(spark_case("p_type", Q14_MASK))
    d = p.select("p_partkey", lvl.alias("masking_level"),
                 R.placebo_flag(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("placebo_flag"),
                 R.cohort_design(spark_case("p_type", Q14_COHORT)).alias("cohort_design"),
                 R.contains_flag(safety, R.SAFETY_PATTERN).alias("safety_cuts_flag"),
                 R.contains_flag("p_brand", R.YES_PATTERN).alias("fda_drug_flag"),
                 R.contains_flag(F.when(F.col("p_type") == "SMALL", "Yes").otherwise("No"),
                                 R.YES_PATTERN).alias("fda_device_flag"))
    return d.select("p_partkey", "masking_level", R.masking_flag("masking_level").cast("long").alias("masking_flag"),
                    R.flag01("placebo_flag").cast("long").alias("placebo_flag"), "cohort_design",
                    *[R.flag01(c).cast("long").alias(c) for c in
                      ("safety_cuts_flag", "fda_drug_flag", "fda_device_flag")])


# ---------------------------------------------------------------------------
# q15 safe division
# ---------------------------------------------------------------------------

@query("q15_active_prob", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round(coalesce(1.0 - (CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.0 END)
                      / nullif(CAST(l_linenumber - 1 AS DOUBLE), 0.0), 1.0), 4) AS active_prob
FROM lineitem
""")
def q15(spark, sf):
    li = T(spark, sf, "lineitem")
    placebo = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
    return li.select("l_orderkey", F.col("l_linenumber").cast("long"),
                     r4(R.active_prob(placebo, F.col("l_linenumber") - 1)).alias("active_prob"))


# ---------------------------------------------------------------------------
# q17 arms from arrays or stringified lists (F8)
# ---------------------------------------------------------------------------

@query("q17_arms", """
WITH l AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_returnflag) AS lines,
                  list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS flags, count(*) AS n
           FROM lineitem GROUP BY l_orderkey),
s AS (SELECT o_orderkey, lines, CASE o_orderpriority
        WHEN '1-URGENT' THEN '[None, ' || CAST(n AS VARCHAR) || ']'
        WHEN '2-HIGH' THEN '[' || array_to_string(lines, ', ') || ']'
        WHEN '3-MEDIUM' THEN '[' || array_to_string(list_transform(flags, lambda x: '''' || x || ''''), ', ') || ']'
        WHEN '4-NOT SPECIFIED' THEN '[' || array_to_string(lines, ', ')
        ELSE CAST(n AS VARCHAR) || ' arms' END AS txt
      FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
j AS (SELECT *, replace(replace(txt, 'None', 'null'), '''', '"') AS js FROM s)
SELECT o_orderkey, coalesce(CAST(len(lines) AS DOUBLE), 1.0) AS arms_arr,
       coalesce(CASE WHEN starts_with(ltrim(txt), '[') AND json_valid(js) THEN CAST(json_array_length(js) AS DOUBLE) END, 1.0)
         AS arms_txt
FROM j
""")
def q17(spark, sf):
    li = T(spark, sf, "lineitem")
    l = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("ls"),
        F.count(F.lit(1)).alias("n"))
    l = l.select("l_orderkey", "n", F.col("ls.l_linenumber").alias("lines"), F.col("ls.l_returnflag").alias("flags"))
    o = T(spark, sf, "orders")
    j = o.join(l, o.o_orderkey == l.l_orderkey, "left")
    nums = F.array_join(F.col("lines").cast("array<string>"), ", ")
    pr = F.col("o_orderpriority")
    txt = (F.when(pr == "1-URGENT", F.concat(F.lit("[None, "), F.col("n").cast("string"), F.lit("]")))
           .when(pr == "2-HIGH", F.concat(F.lit("["), nums, F.lit("]")))
           .when(pr == "3-MEDIUM", F.concat(F.lit("["), F.array_join(
               F.transform("flags", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")))
           .when(pr == "4-NOT SPECIFIED", F.concat(F.lit("["), nums))
           .otherwise(F.concat(F.col("n").cast("string"), F.lit(" arms"))))
    return j.select("o_orderkey", R.count_arm_groups("lines", is_array=True).alias("arms_arr"),
                    R.count_arm_groups(txt).alias("arms_txt"))


# ---------------------------------------------------------------------------
# q18 epoch seconds, years, log target, yes/no
# ---------------------------------------------------------------------------

@query("q18_time", f"""
WITH {_ORDER_DATES_SQL}
SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', start) AS DOUBLE) * 86400.0 AS start_date_ts,
       round(date_diff('day', start, complete) / 365.25, 4) AS duration_years,
       round(date_diff('day', start, complete) / 365.0, 4) AS duration_years_365,
       round(CASE WHEN date_diff('day', start, complete) > 0 THEN ln(date_diff('day', start, complete)) END, 4)
         AS log_days,
       CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS status_flag,
       CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority_num
FROM od
""")
def q18(spark, sf):
    d = _order_dates(spark, sf).withColumn("days", R.day_diff("complete", "start"))
    d = d.select("o_orderkey", R.epoch_seconds("start").alias("start_date_ts"),
                 r4(R.days_to_years("days")).alias("duration_years"),
                 r4(R.days_to_years("days", 365.0)).alias("duration_years_365"),
                 r4(R.log_days("days")).alias("log_days"),
                 (F.col("o_orderstatus") == "F").cast("int").alias("status_flag"),
                 F.substring("o_orderpriority", 1, 1).cast("long").alias("priority_num"))
    return cohort.coerce_flags(d, ["status_flag", "priority_num"])


# ---------------------------------------------------------------------------
# q19/q20 rolling frequency + novelty
# ---------------------------------------------------------------------------

_Q19_SQL = """
WITH b AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders),
f AS (SELECT o_orderkey, o_custkey,
        count(*) OVER (PARTITION BY o_custkey ORDER BY d
                       RANGE BETWEEN INTERVAL 1824 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)
        + row_number() OVER (PARTITION BY o_custkey, d ORDER BY o_orderkey) AS freq
      FROM b)
SELECT o_orderkey, o_custkey, CAST(freq AS BIGINT) AS freq_in_window, round(1.0 / freq, 4) AS novelty_score FROM f
"""


def _q19(spark, sf, o=None):
    o = T(spark, sf, "orders") if o is None else o
    o = o.select("o_orderkey", "o_custkey", "o_orderdate")
    f = novelty.trailing_frequency(o, "o_custkey", "o_orderdate", "o_orderkey", 1825)
    f = novelty.novelty_score(f)
    return f.select("o_orderkey", "o_custkey", "freq_in_window", r4("novelty_score").alias("novelty_score"))


@query("q19_novelty", _Q19_SQL)
def q19(spark, sf):
    return _q19(spark, sf)


@query("q20_novelty_preagg", _Q19_SQL)
def q20(spark, sf):
    """The same from another layout of the input."""
    return _q19(spark, sf, T(spark, sf, "orders").repartition("o_orderdate"))


# ---------------------------------------------------------------------------
# q21 vector left join + coverage + expansion (J1 A13 T6x)
# ---------------------------------------------------------------------------

EMB_DIMS = 64  # width in the SQL; the query takes it from the data


@query("q21_vectors", "SELECT doc_id, CAST(embedding IS NULL OR list_has_any(list_transform(embedding, lambda x: x IS NULL), [true]) AS BIGINT) AS missing_vec, "
       + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 4) AS emb_{i:03d}" for i in range(EMB_DIMS))
       + " FROM documents d LEFT JOIN embeddings e ON upper(trim(CAST(e.vec_id AS VARCHAR))) = upper(trim(CAST(d.doc_id AS VARCHAR)))")
def q21(spark, sf):
    d = T(spark, sf, "documents").select("doc_id")
    j = vectors.vector_left_join(d, "doc_id", T(spark, sf, "embeddings"), "vec_id", "embedding")
    width = T(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    return j.select("doc_id", vectors.missing_vector("embedding").alias("missing_vec"),
                    *vectors.expand_columns("embedding", width, "emb_", digits=4))


# ---------------------------------------------------------------------------
# q22 semi / anti / absent ids
# ---------------------------------------------------------------------------

@query("q22_id_sets", """
SELECT 'semi' AS kind, doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL
SELECT 'anti' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL
SELECT DISTINCT 'missing' AS kind, vec_id * 3 AS id FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)
""")
def q22(spark, sf):
    docs, lab = T(spark, sf, "documents").select("doc_id"), T(spark, sf, "labels")
    good = lab.where("quality = 1").select(F.col("doc_id").alias("id"))
    toxic = lab.where("toxic = 1").select(F.col("doc_id").alias("id"))
    req = T(spark, sf, "embeddings").select((F.col("vec_id") * 3).alias("id"))
    a = split.restrict(docs, "doc_id", good).select(F.lit("semi").alias("kind"), F.col("doc_id").alias("id"))
    b = split.exclude(docs, "doc_id", toxic).select(F.lit("anti").alias("kind"), F.col("doc_id").alias("id"))
    c = split.absent_ids(req, docs, "doc_id").select(F.lit("missing").alias("kind"), F.col("doc_id").alias("id"))
    return a.unionByName(b).unionByName(c)


# ---------------------------------------------------------------------------
# q23 split with overlap policies
# ---------------------------------------------------------------------------

@query("q23_splits", """
WITH tr AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
te AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
ids AS (SELECT coalesce(tr.doc_id, te.doc_id) AS doc_id, tr.doc_id IS NOT NULL AS in_train, te.doc_id IS NOT NULL AS in_test
        FROM tr FULL OUTER JOIN te ON tr.doc_id = te.doc_id),
r AS (SELECT d.doc_id, CASE WHEN in_test THEN 'test' ELSE 'train' END AS s_test,
             CASE WHEN in_train THEN 'train' ELSE 'test' END AS s_train
      FROM documents d JOIN ids ON d.doc_id = ids.doc_id)
SELECT 'test_wins' AS policy, s_test AS split, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids FROM r GROUP BY s_test
UNION ALL
SELECT 'train_wins' AS policy, s_train AS split, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids FROM r GROUP BY s_train
UNION ALL
SELECT 'overlap' AS policy, 'both' AS split, count(*) AS n_rows, count(*) AS n_ids
FROM (SELECT doc_id FROM tr INTERSECT SELECT doc_id FROM te)
""")
def q23(spark, sf):
    docs, lab = T(spark, sf, "documents").select("doc_id"), T(spark, sf, "labels")
    tr = lab.where("quality = 1").select(F.col("doc_id").alias("id"))
    te = lab.where("toxic = 1").select(F.col("doc_id").alias("id"))
    parts = []
    for policy, ov in (("test_wins", "test"), ("train_wins", "train")):
        r = split.assign_split(docs, "doc_id", tr, te, overlap=ov)
        parts.append(split.split_counts(r, "doc_id").select(F.lit(policy).alias("policy"), "split", "n_rows", "n_ids"))
    both = tr.distinct().intersect(te.distinct())
    parts.append(both.agg(F.count(F.lit(1)).alias("n_rows"))
                 .select(F.lit("overlap").alias("policy"), F.lit("both").alias("split"), "n_rows",
                         F.col("n_rows").alias("n_ids")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# q24 ordered result, truth lookup, block concat
# ---------------------------------------------------------------------------

SEEDS = [42, 43, 44, 45, 46]


@query("q24_ordered", """
WITH lst AS (SELECT doc_id, (doc_id * 37) % 1009 AS pos FROM labels),
runs AS (SELECT d.doc_id, pos, s AS seed, CAST(n_chars AS DOUBLE) AS truth,
                n_chars * (1 + (s - 44) / 100.0) AS pred
         FROM documents d JOIN lst ON d.doc_id = lst.doc_id, unnest([42, 43, 44, 45, 46]) t(s)),
model AS (SELECT doc_id, min(pos) AS pos, arg_min(truth, seed) AS truth, avg(pred) AS pred FROM runs GROUP BY doc_id),
base AS (SELECT doc_id, pos, truth, (SELECT avg(truth) FROM model) AS pred FROM model),
blocks AS (SELECT 'baseline' AS block, * FROM base UNION ALL SELECT 'model' AS block, * FROM model)
SELECT block, doc_id, pos, round(truth, 4) AS truth, round(pred, 4) AS pred, round(abs(pred - truth), 4) AS abs_err
FROM blocks
""")
def q24(spark, sf):
    lst = T(spark, sf, "labels").select(F.col("doc_id").alias("id"), ((F.col("doc_id") * 37) % 1009).alias("pos"))
    docs = T(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("truth"))
    runs = (split.ordered_by_list(docs, "doc_id", lst, sort=False)
            .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
            .withColumn("pred", F.col("truth") * (1 + (F.col("seed") - 44) / 100.0)))
    truth = split.first_by_position(runs, "doc_id", "truth", "seed")
    model = runs.groupBy("doc_id").agg(F.min("pos").alias("pos"), F.avg("pred").alias("pred")).join(truth, "doc_id")
    mean = model.agg(F.avg("truth")).first()[0]
    base = model.select("doc_id", "pos", "truth", F.lit(mean).alias("pred"))
    out = reports.concat_blocks([("baseline", base), ("model", model)])
    out = out.withColumn("abs_err", F.abs(F.col("pred") - F.col("truth")))
    out = out.orderBy(F.col("block") == "baseline", "pos", ascending=[False, True])
    return out.select("block", "doc_id", "pos", r4("truth").alias("truth"), r4("pred").alias("pred"),
                      r4("abs_err").alias("abs_err"))


# ---------------------------------------------------------------------------
# q25 metrics vs mean baseline (A5 M8)
# ---------------------------------------------------------------------------

@query("q25_metrics", """
WITH tr AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
te AS (SELECT * FROM orders WHERE o_orderstatus = 'O'),
g AS (SELECT o_orderpriority, avg(o_totalprice) AS gm FROM tr GROUP BY o_orderpriority),
p AS (SELECT 'mean_baseline' AS model, o_totalprice AS y, (SELECT avg(o_totalprice) FROM tr) AS yhat FROM te
      UNION ALL
      SELECT 'priority_mean' AS model, o_totalprice AS y, coalesce(gm, (SELECT avg(o_totalprice) FROM tr)) AS yhat
      FROM te LEFT JOIN g ON te.o_orderpriority = g.o_orderpriority)
SELECT model, count(*) AS n, round(avg(abs(yhat - y)), 4) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 4) AS rmse,
       round(1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(*)), 4) AS r2
FROM p GROUP BY model
""")
def q25(spark, sf):
    o = T(spark, sf, "orders")
    tr, te = o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")
    from ..operators.model import mean_baseline
    mean = mean_baseline(tr, "o_totalprice")
    g = tr.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("gm"))
    a = te.select(F.lit("mean_baseline").alias("model"), F.col("o_totalprice").alias("y"), F.lit(mean).alias("yhat"))
    b = te.join(g, "o_orderpriority", "left").select(
        F.lit("priority_mean").alias("model"), F.col("o_totalprice").alias("y"),
        F.coalesce("gm", F.lit(mean)).alias("yhat"))
    m = reports.error_metrics(a.unionByName(b), "y", "yhat", by=["model"])
    return m.select("model", "n", r4("mae").alias("mae"), r4("rmse").alias("rmse"), r4("r2").alias("r2"))


# ---------------------------------------------------------------------------
# q26 per-entity stats and seed summary (A1 A2 A3 A4)
# ---------------------------------------------------------------------------

_RUNS_SQL = """
runs AS (SELECT o_orderkey, o_orderpriority AS model, s AS seed, o_totalprice AS truth,
                o_totalprice * (1 + (s - 44) / 100.0) + (o_custkey % 7) * 10.0 AS pred
         FROM orders, unnest([42, 43, 44, 45, 46]) t(s)),
e AS (SELECT *, abs(pred - truth) AS err FROM runs)"""


def _runs(spark, sf):
    o = T(spark, sf, "orders")
    r = o.select("o_orderkey", F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("truth"),
                 "o_custkey", F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed"))
    r = r.withColumn("pred", F.col("truth") * (1 + (F.col("seed") - 44) / 100.0) + (F.col("o_custkey") % 7) * 10.0)
    return r.withColumn("err", F.abs(F.col("pred") - F.col("truth")))


@query("q26_entity", f"""
WITH {_RUNS_SQL}
SELECT o_orderkey, count(*) AS n_runs, round(avg(err), 4) AS err_mean, round(coalesce(stddev_samp(err), 0), 4) AS err_std,
       round(avg(truth), 4) AS truth_mean, round(avg(pred), 4) AS pred_mean,
       round(coalesce(stddev_samp(pred), 0), 4) AS pred_std, round(avg(err) / 365.25, 4) AS err_mean_years
FROM e GROUP BY o_orderkey
""")
def q26_entity(spark, sf):
    s = reports.per_entity_stats(_runs(spark, sf), "o_orderkey", "err", "truth", "pred")
    return s.select("o_orderkey", "n_runs", *[r4(c).alias(c) for c in
                                              ("err_mean", "err_std", "truth_mean", "pred_mean", "pred_std",
                                               "err_mean_years")])


@query("q26_seed_summary", f"""
WITH {_RUNS_SQL},
m AS (SELECT model, seed, avg(err) AS mae, sqrt(avg(err * err)) AS rmse,
             1 - sum(err * err) / (var_pop(truth) * count(*)) AS r2 FROM e GROUP BY model, seed
      UNION ALL
      SELECT 'ALL' AS model, seed, avg(err), sqrt(avg(err * err)), 1 - sum(err * err) / (var_pop(truth) * count(*))
      FROM e GROUP BY seed)
SELECT model, count(*) AS n_seeds, round(avg(mae), 4) AS mae_mean, round(stddev_samp(mae), 4) AS mae_std,
       round(avg(rmse), 4) AS rmse_mean, round(avg(r2), 4) AS r2_mean
FROM m GROUP BY model
""")
def q26_seed(spark, sf):
    r = _runs(spark, sf)
    per = reports.error_metrics(r, "truth", "pred", by=["model", "seed"])
    run = reports.error_metrics(r, "truth", "pred", by=["seed"]).withColumn("model", F.lit("ALL"))
    s = reports.seed_summary(per.unionByName(run), ["model"])
    return s.select("model", "n_seeds", *[r4(c).alias(c) for c in ("mae_mean", "mae_std", "rmse_mean", "r2_mean")])


# ---------------------------------------------------------------------------
# q27 planned vs actual durations
# ---------------------------------------------------------------------------

@query("q27_expert", f"""
WITH {_ORDER_DATES_SQL},
s AS (SELECT o_orderkey, o_custkey, strftime(start, '%Y-%m-%d') AS fpfv_plan,
             CASE WHEN o_orderpriority = '5-LOW' THEN 'TBD' ELSE strftime(first_ship, '%Y-%m-%d') END AS lplv_plan,
             strftime(start, '%Y-%m-%d') AS fpfv_act, strftime(complete, '%Y-%m-%d') AS lplv_act FROM od),
d AS (SELECT o_orderkey, o_custkey,
             date_diff('day', TRY_CAST(fpfv_plan AS DATE), TRY_CAST(lplv_plan AS DATE)) AS manual_days,
             date_diff('day', TRY_CAST(fpfv_act AS DATE), TRY_CAST(lplv_act AS DATE)) AS actual_days FROM s),
c AS (SELECT *, actual_days - manual_days AS delta_days FROM d WHERE manual_days IS NOT NULL AND actual_days IS NOT NULL),
f AS (SELECT * FROM c WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT 'all' AS scope, count(*) AS n, round(avg(abs(delta_days) / 365.0), 4) AS mae_years,
       round(avg(delta_days / 365.0), 4) AS signed_years FROM c
UNION ALL
SELECT 'filtered' AS scope, count(*) AS n, round(avg(abs(delta_days) / 365.0), 4) AS mae_years,
       round(avg(delta_days / 365.0), 4) AS signed_years FROM f
""")
def q27(spark, sf):
    d = _order_dates(spark, sf)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd")
    s = d.select("o_orderkey", "o_custkey", fmt("start").alias("fpfv_plan"),
                 F.when(F.col("o_orderpriority") == "5-LOW", F.lit("TBD")).otherwise(fmt("first_ship")).alias("lplv_plan"),
                 fmt("start").alias("fpfv_act"), fmt("complete").alias("lplv_act"))
    c = reports.planned_vs_actual(s, "fpfv_plan", "lplv_plan", "fpfv_act", "lplv_act")
    bld = T(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    f = split.exclude(c, "o_custkey", bld)
    out = reports.expert_error(c, "all").unionByName(reports.expert_error(f, "filtered"))
    return out.select("scope", "n", r4("mae_years").alias("mae_years"), r4("signed_years").alias("signed_years"))


# ---------------------------------------------------------------------------
# q28 describe, histogram, box
# ---------------------------------------------------------------------------

@query("q28_describe", """
WITH q AS (SELECT quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.75, 0.95]) AS p, count(o_totalprice) AS n,
                  avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS mn,
                  max(o_totalprice) AS mx FROM orders)
SELECT n AS count, round(mean, 4) AS mean, round(std, 4) AS std, round(mn, 4) AS min, round(p[1], 4) AS p05,
       round(p[2], 4) AS p25, round(p[3], 4) AS p50, round(p[4], 4) AS p75, round(p[5], 4) AS p95, round(mx, 4) AS max
FROM q
""")
def q28_describe(spark, sf):
    d = reports.describe(T(spark, sf, "orders"), "o_totalprice")
    return d.select("count", *[r4(c).alias(c) for c in d.columns if c != "count"])


@query("q28_histogram", """
WITH r AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders),
b AS (SELECT CAST(least(floor((o_totalprice - mn) * 30 / (mx - mn)) + 1, 30) AS BIGINT) AS bin, mn, mx
      FROM orders, r WHERE o_totalprice IS NOT NULL)
SELECT bin, round(any_value(mn) + (bin - 1) * (any_value(mx) - any_value(mn)) / 30, 4) AS lo,
       round(any_value(mn) + bin * (any_value(mx) - any_value(mn)) / 30, 4) AS hi, count(*) AS n
FROM b GROUP BY bin
""")
def q28_histogram(spark, sf):
    h = reports.histogram(T(spark, sf, "orders"), "o_totalprice", 30)
    return h.select("bin", r4("lo").alias("lo"), r4("hi").alias("hi"), "n")


@query("q28_box", """
WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS p FROM orders),
b AS (SELECT p[1] AS q1, p[2] AS med, p[3] AS q3, p[3] - p[1] AS iqr FROM q)
SELECT round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, round(iqr, 4) AS iqr,
       round(min(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * iqr AND q3 + 1.5 * iqr THEN o_totalprice END), 4) AS whisker_lo,
       round(max(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * iqr AND q3 + 1.5 * iqr THEN o_totalprice END), 4) AS whisker_hi,
       count(CASE WHEN NOT (o_totalprice BETWEEN q1 - 1.5 * iqr AND q3 + 1.5 * iqr) THEN 1 END) AS n_outliers
FROM orders, b GROUP BY q1, med, q3, iqr
""")
def q28_box(spark, sf):
    b = reports.box_stats(T(spark, sf, "orders"), "o_totalprice")
    return b.select(*[r4(c).alias(c) for c in ("q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi")],
                    "n_outliers")


# ---------------------------------------------------------------------------
# q29 profile, value counts, build report
# ---------------------------------------------------------------------------

@query("q29_profile", """
SELECT column_name, dtype, non_null, nulls FROM (
  SELECT 'event_id' AS column_name, 'bigint' AS dtype, count(event_id) AS non_null, count(*) - count(event_id) AS nulls, 1 AS o FROM events
  UNION ALL SELECT 'ts', 'timestamp_ntz', count(ts), count(*) - count(ts), 2 FROM events
  UNION ALL SELECT 'user_id', 'bigint', count(user_id), count(*) - count(user_id), 3 FROM events
  UNION ALL SELECT 'event_type', 'string', count(event_type), count(*) - count(event_type), 4 FROM events
  UNION ALL SELECT 'value', 'double', count(value), count(*) - count(value), 5 FROM events
  UNION ALL SELECT 'props', 'string', count(props), count(*) - count(props), 6 FROM events)
""")
def q29_profile(spark, sf):
    return reports.profile(T(spark, sf, "events"))


@query("q29_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q29_values(spark, sf):
    return reports.value_counts(T(spark, sf, "events"), "event_type")


@query("q29_build_report", """
SELECT count(*) AS n_rows, count(value) AS value_non_null, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts_min,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts_max, count(DISTINCT event_type) AS n_event_types,
       round(min(value), 4) AS value_min, round(max(value), 4) AS value_max
FROM events
""")
def q29_report(spark, sf):
    e = T(spark, sf, "events")
    r = reports.build_report(e, "value", "event_type", scores=("ts",))
    return r.select(F.col("rows").alias("n_rows"), F.col("durations_non_null").alias("value_non_null"),
                    F.date_format("ts_min", "yyyy-MM-dd HH:mm:ss").alias("ts_min"),
                    F.date_format("ts_max", "yyyy-MM-dd HH:mm:ss").alias("ts_max"),
                    F.col("event_type_distinct").alias("n_event_types"),
                    r4("duration_min").alias("value_min"), r4("duration_max").alias("value_max"))


# ---------------------------------------------------------------------------
# q30 median / mode imputation, scaling, one-hot index (M1 M2)
# ---------------------------------------------------------------------------

_Q30_BASE_SQL = """
b AS (SELECT o_orderkey, o_orderstatus,
             CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price,
             CASE WHEN o_orderkey % 7 = 0 THEN NULL
                  WHEN o_orderstatus = 'P' AND o_custkey % 13 = 0 THEN 'X-NEW' ELSE o_orderpriority END AS prio
      FROM orders),
tr AS (SELECT * FROM b WHERE o_orderstatus = 'F')"""


@query("q30_impute", f"""
WITH {_Q30_BASE_SQL},
med AS (SELECT quantile_cont(price, 0.5) AS m FROM tr),
st AS (SELECT avg(coalesce(price, m)) AS mu, stddev_pop(coalesce(price, m)) AS sd FROM tr, med),
md AS (SELECT prio AS mode FROM tr WHERE prio IS NOT NULL GROUP BY prio ORDER BY count(*) DESC, prio ASC LIMIT 1),
cats AS (SELECT DISTINCT coalesce(prio, (SELECT mode FROM md)) AS c FROM tr)
SELECT o_orderkey, round(coalesce(price, m), 4) AS price_imputed, round((coalesce(price, m) - mu) / sd, 4) AS price_scaled,
       coalesce(prio, (SELECT mode FROM md)) AS prio_imputed,
       CASE WHEN coalesce(prio, (SELECT mode FROM md)) IN (SELECT c FROM cats)
            THEN (SELECT count(*) FROM cats WHERE c < coalesce(prio, (SELECT mode FROM md))) END AS prio_index
FROM b, med, st
""")
def q30(spark, sf):
    from ..operators.model import ImputeScale
    o = T(spark, sf, "orders")
    b = o.select("o_orderkey", "o_orderstatus",
                 F.when(F.col("o_orderkey") % 10 == 0, F.lit(None).cast("double"))
                 .otherwise(F.col("o_totalprice")).alias("price"),
                 F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string"))
                 .when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 13 == 0), F.lit("X-NEW"))
                 .otherwise(F.col("o_orderpriority")).alias("prio"))
    m = ImputeScale(num_cols=["price"], cat_cols=["prio"]).fit(b.where("o_orderstatus = 'F'"))
    t = m.transform(b)
    return t.select("o_orderkey", r4("price_imputed").alias("price_imputed"),
                    r4("price_scaled").alias("price_scaled"), "prio_imputed",
                    F.col("prio_index").cast("long").alias("prio_index"))


# ---------------------------------------------------------------------------
# q31 quantile-uniform transform + weighted, min-max score
# ---------------------------------------------------------------------------

Q31_COLS = ["n_lines", "qty", "disc"]
Q31_BETA = [0.5, 0.3, 0.2]


def _qt_sql(x, c):
    q = [f"k_{c}[{i}]" for i in range(1, 6)]
    r = [0.0, 0.25, 0.5, 0.75, 1.0]
    fwd = " ".join(f"WHEN {x} >= {q[i]} THEN {r[i]} + ({x} - {q[i]}) * {r[i + 1] - r[i]} / ({q[i + 1]} - {q[i]})"
                   for i in range(3, -1, -1))
    fwd = f"CASE WHEN {x} >= {q[4]} THEN 1.0 {fwd} ELSE 0.0 END"
    bwd = " ".join(f"WHEN {x} <= {q[i]} THEN {r[i - 1]} + ({x} - {q[i - 1]}) * {r[i] - r[i - 1]} / ({q[i]} - {q[i - 1]})"
                   for i in range(1, 5))
    bwd = f"CASE WHEN {x} <= {q[0]} THEN 0.0 {bwd} ELSE 1.0 END"
    return (f"CASE WHEN {x} = {q[0]} THEN 0.0 WHEN {x} = {q[4]} THEN 1.0 "
            f"ELSE 0.5 * (({fwd}) + ({bwd})) END")


@query("q31_quantile_score", f"""
WITH f AS (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS qty, avg(l_discount) AS disc
           FROM lineitem GROUP BY l_orderkey),
k AS (SELECT quantile_cont(n_lines, [0, 0.25, 0.5, 0.75, 1]) AS k_n_lines, quantile_cont(qty, [0, 0.25, 0.5, 0.75, 1]) AS k_qty,
             quantile_cont(disc, [0, 0.25, 0.5, 0.75, 1]) AS k_disc FROM f),
u AS (SELECT l_orderkey, {_qt_sql('n_lines', 'n_lines')} AS u_lines, {_qt_sql('qty', 'qty')} AS u_qty,
             {_qt_sql('disc', 'disc')} AS u_disc FROM f, k),
s AS (SELECT *, {Q31_BETA[0]} * u_lines + {Q31_BETA[1]} * u_qty + {Q31_BETA[2]} * u_disc AS raw FROM u)
SELECT l_orderkey, round(u_lines, 4) AS u_lines, round(u_qty, 4) AS u_qty, round(u_disc, 4) AS u_disc,
       round(100 * (raw - (SELECT min(raw) FROM s)) / ((SELECT max(raw) FROM s) - (SELECT min(raw) FROM s)), 4) AS score
FROM s
""")
def q31(spark, sf):
    from ..operators.scores import weighted_score
    f = (T(spark, sf, "lineitem").groupBy("l_orderkey")
         .agg(F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("qty"),
              F.avg("l_discount").alias("disc")))
    qt = QuantileUniform(Q31_COLS, ["u_lines", "u_qty", "u_disc"], n_quantiles=5).fit(f)
    u = qt.transform(f)
    s, _, _ = weighted_score(u, ["u_lines", "u_qty", "u_disc"], Q31_BETA, "score")
    return s.select("l_orderkey", *[r4(c).alias(c) for c in ("u_lines", "u_qty", "u_disc", "score")])


# ---------------------------------------------------------------------------
# q32 text clean / redact (T2x T3x)
# ---------------------------------------------------------------------------

def _q32_text(spark, sf):
    p = T(spark, sf, "pages")
    a = (F.col("page_id") % 24 + 1).cast("string")
    b = (F.col("page_id") % 24 + 13).cast("string")
    c = (F.col("page_id") % 9 + 1).cast("string")
    suffix = F.concat(F.lit("<p>Follow-up "), a, F.lit("-"), b, F.lit(" months, up to "), c,
                      F.lit(" years • at least 2.5 days</p>\n\n\n\nEnd"))
    return p.select("page_id", F.concat("html", suffix).alias("t"))


# entities the oracle decodes (the ones present in the driver's pages); &amp; last
_ENTITIES = [("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
             ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _clean_sql(t, redact=False):
    s = t
    for e, ch in _ENTITIES:
        s = f"replace({s}, '{e}', '{ch.replace(chr(39), chr(39) * 2)}')"
    s = f"regexp_replace({s}, '<[^>]+>', ' ', 'g')"
    s = f"replace(replace({s}, '•', '*'), chr(160), ' ')"
    s = _strip_sql(f"regexp_replace({s}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')")
    s = f"regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    if redact:
        pat = TX.DURATION.replace("(?i)", "")
        s = f"regexp_replace({s}, '(?i){pat}', ' <DURATION> ', 'g')"
        s = _strip_sql(f"regexp_replace({s}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')")
    return f"CASE WHEN {t} IS NULL OR {_strip_sql(t)} = '' THEN '' ELSE {s} END"


@query("q32_clean_text", """
WITH p AS (SELECT page_id, html || '<p>Follow-up ' || CAST(page_id % 24 + 1 AS VARCHAR) || '-' ||
                  CAST(page_id % 24 + 13 AS VARCHAR) || ' months, up to ' || CAST(page_id % 9 + 1 AS VARCHAR) ||
                  ' years • at least 2.5 days</p>' || chr(10) || chr(10) || chr(10) || chr(10) || 'End' AS t FROM pages)
SELECT page_id, """ + _clean_sql("t") + " AS cleaned, " + _clean_sql("t", True) + " AS redacted FROM p")
def q32(spark, sf):
    p = _q32_text(spark, sf)
    return p.select("page_id", TX.clean_text("t").alias("cleaned"), TX.clean_text("t", redact=True).alias("redacted"))


# ---------------------------------------------------------------------------
# q33 sentences and token caps (T4x) -- whole texts, caps reported as flags
# ---------------------------------------------------------------------------

MAX_SENTENCES, MAX_TOKENS = 40, 32


@query("q33_sentences", f"""
WITH s AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '. ')) AS sentence,
                  unnest(generate_series(0, len(string_split(coalesce(text, ''), '. ')) - 1)) AS sent_idx
           FROM documents)
SELECT doc_id, CAST(sent_idx AS BIGINT) AS sent_idx,
       CAST(len(regexp_extract_all(sentence, '[^\\s]+')) AS BIGINT) AS n_tokens,
       CAST(least(len(regexp_extract_all(sentence, '[^\\s]+')), {MAX_TOKENS}) AS BIGINT) AS n_tokens_capped,
       CAST(sent_idx < {MAX_SENTENCES} AS BIGINT) AS in_window
FROM s
""")
def q33(spark, sf):
    d = T(spark, sf, "documents")
    s = d.select("doc_id", F.posexplode(TX.sentences("text")).alias("sent_idx", "sentence"))
    n = F.size(F.regexp_extract_all("sentence", F.lit(r"[^\s]+"), 0))
    return s.select("doc_id", F.col("sent_idx").cast("long"), n.cast("long").alias("n_tokens"),
                    F.least(n, F.lit(MAX_TOKENS)).cast("long").alias("n_tokens_capped"),
                    (F.col("sent_idx") < MAX_SENTENCES).cast("long").alias("in_window"))


# ---------------------------------------------------------------------------
# q34 fuzzy harmonisation
# ---------------------------------------------------------------------------

def _q34_values_sql():
    return ("CASE WHEN p_size = 50 THEN split_part(p_name, ' ', 2) "
            "WHEN p_size % 10 = 9 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' extra' "
            "ELSE CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, 2) || substr(p_name, 4) "
            "WHEN 2 THEN upper(replace(p_name, ' ', '_')) WHEN 3 THEN p_name || 'xx' "
            "ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END END")


def _norm_name_sql(c):
    s = f"lower(trim({c}))"
    s = f"replace(replace({s}, '#', 'num '), 'number', 'num')"
    s = f"regexp_replace({s}, '[_\\-/]+', ' ', 'g')"
    s = f"replace(replace(replace({s}, 'count', 'n'), 'randomised', 'randomized'), 'trial', '')"
    return f"regexp_replace({s}, '\\s+', ' ', 'g')"


def _q34_inputs(spark, sf):
    p = T(spark, sf, "part")
    sz = F.col("p_size") % 5
    w = F.split("p_name", " ")
    value = (F.when(F.col("p_size") == 50, F.get(w, 1))
             .when(F.col("p_size") % 10 == 9, F.concat_ws(" ", F.get(w, 1), F.get(w, 0), F.lit("extra")))
             .when(sz == 0, F.col("p_name"))
             .when(sz == 1, F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1 << 30)))
             .when(sz == 2, F.upper(F.regexp_replace("p_name", " ", "_")))
             .when(sz == 3, F.concat("p_name", F.lit("xx")))
             .otherwise(F.concat_ws(" ", F.get(w, 1), F.get(w, 0))))
    vals = p.select("p_partkey", value.alias("value"))
    canon = p.select(F.col("p_name").alias("canonical")).distinct()
    syn = canon.select("canonical", F.concat_ws(" ", F.get(F.split("canonical", " "), 1),
                                                F.get(F.split("canonical", " "), 0)).alias("synonym"))
    return vals, canon, syn


@query("q34_harmonise", f"""
WITH v AS (SELECT DISTINCT {_q34_values_sql()} AS value FROM part),
vn AS (SELECT value, {_norm_name_sql('value')} AS nv FROM v),
c AS (SELECT DISTINCT p_name AS canonical FROM part),
cn AS (SELECT canonical, {_norm_name_sql('canonical')} AS nc FROM c),
syn AS (SELECT canonical, split_part(canonical, ' ', 2) || ' ' || split_part(canonical, ' ', 1) AS syn FROM c),
sn AS (SELECT canonical, syn, {_norm_name_sql('syn')} AS ns FROM syn),
cand AS (
  SELECT value, canonical, 1.0 AS confidence, 'exact' AS reason, 0 AS dist, 0 AS tier FROM vn JOIN cn ON nv = nc
  UNION ALL
  SELECT DISTINCT value, canonical, 0.95, 'synonym:' || syn, 0, 1 FROM vn JOIN sn
    ON nv <> '' AND ns <> '' AND (contains(nv, ns) OR contains(ns, nv))
  UNION ALL
  SELECT value, canonical, 1.0 - levenshtein(nv, nc) / greatest(length(nv), length(nc), 1), 'fuzzy', levenshtein(nv, nc), 2
  FROM vn, cn WHERE 1.0 - levenshtein(nv, nc) / greatest(length(nv), length(nc), 1) >= 0.7),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY confidence DESC, tier, dist, canonical, reason) AS r
                        FROM cand) WHERE r = 1)
SELECT p_partkey, x.value, canonical AS match, round(confidence, 4) AS confidence, reason
FROM (SELECT p_partkey, {_q34_values_sql()} AS value FROM part) x LEFT JOIN best ON x.value = best.value
""")
def q34(spark, sf):
    vals, canon, syn = _q34_inputs(spark, sf)
    h = harmonise.harmonise(vals, "value", canon, syn, threshold=0.70, measure="edits")
    return h.select("p_partkey", "value", "match", r4("confidence").alias("confidence"), "reason")


# ---------------------------------------------------------------------------
# q35 top-k
# ---------------------------------------------------------------------------

@query("q35_topk", """
SELECT p_partkey, p_name, round(p_retailprice, 4) AS p_retailprice FROM part
ORDER BY p_retailprice DESC, p_partkey LIMIT 20
""")
def q35(spark, sf):
    t = reports.top_k(T(spark, sf, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 20)
    return t.select("p_partkey", "p_name", r4("p_retailprice").alias("p_retailprice"))


# ---------------------------------------------------------------------------
# q36 ID-list parsing
# ---------------------------------------------------------------------------

def _q36_lines(spark, sf):
    lab = T(spark, sf, "labels")
    nid = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    value = (F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit("   "))
             .when(F.col("toxic") == 1, F.concat(F.lit("nct"), nid, F.lit("  extra,NCT"), nid, F.lit("9")))
             .otherwise(F.concat(F.lit(" NCT"), nid, F.lit(" "))))
    return lab.select(value.alias("value"), F.col("doc_id").alias("pos"))


_Q36_LINES_SQL = """
ln AS (SELECT CASE WHEN quality = 0 AND toxic = 0 THEN '   '
                   WHEN toxic = 1 THEN 'nct' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '  extra,NCT' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '9'
                   ELSE ' NCT' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || ' ' END AS value, doc_id AS pos FROM labels)"""


@query("q36_id_lists", f"""
WITH {_Q36_LINES_SQL},
s4 AS (SELECT DISTINCT upper({_strip_sql('value')}) AS id FROM ln WHERE {_strip_sql('value')} <> ''),
s5 AS (SELECT DISTINCT upper(string_split_regex({_strip_sql('value')}, '\\s+')[1]) AS id FROM ln WHERE {_strip_sql('value')} <> ''),
s6 AS (SELECT upper({_strip_sql('value')}) AS id, min(pos) AS pos FROM ln WHERE {_strip_sql('value')} <> '' GROUP BY 1),
tok AS (SELECT upper({_strip_sql('t')}) AS id FROM (SELECT unnest(string_split_regex(value, '[,\\s]+')) AS t FROM ln)),
s7 AS (SELECT DISTINCT id FROM tok WHERE regexp_full_match(id, 'NCT[0-9]{{8,10}}')),
p5 AS (SELECT page_id, nullif(upper(regexp_extract(url || '?trial=' || CASE WHEN page_id % 2 = 0 THEN 'NCT' ELSE 'nct' END
                                  || lpad(CAST(page_id AS VARCHAR), 8, '0'), '(NCT[0-9]{{8}})', 1)), '') AS id FROM pages)
SELECT 'S4' AS kind, id, CAST(NULL AS BIGINT) AS pos FROM s4
UNION ALL SELECT 'S5', id, NULL FROM s5
UNION ALL SELECT 'S6', id, pos FROM s6
UNION ALL SELECT 'S7', id, NULL FROM s7
UNION ALL SELECT 'P5', id, page_id FROM p5
""")
def q36(spark, sf):
    ln = _q36_lines(spark, sf)
    nul = F.lit(None).cast("long").alias("pos")
    parts = [idlists.ids_one_per_line(ln).select(F.lit("S4").alias("kind"), "id", nul),
             idlists.ids_first_column(ln).select(F.lit("S5").alias("kind"), "id", nul),
             idlists.ids_ordered(ln).select(F.lit("S6").alias("kind"), "id", F.col("pos").cast("long")),
             idlists.ids_tokens(ln).select(F.lit("S7").alias("kind"), "id", nul)]
    pg = T(spark, sf, "pages")
    url = F.concat("url", F.lit("?trial="), F.when(F.col("page_id") % 2 == 0, "NCT").otherwise("nct"),
                   F.lpad(F.col("page_id").cast("string"), 8, "0"))
    parts.append(pg.select(F.lit("P5").alias("kind"), R.id_from_text(url).alias("id"),
                           F.col("page_id").cast("long").alias("pos")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# q20 skewed: one customer key holds half of all orders (W1 skew-safe form)
# ---------------------------------------------------------------------------

@query("q20_novelty_skewed", """
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_custkey END AS k,
                  CAST(o_orderdate AS DATE) AS d FROM orders),
f AS (SELECT o_orderkey, k,
        count(*) OVER (PARTITION BY k ORDER BY d RANGE BETWEEN INTERVAL 1824 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)
        + row_number() OVER (PARTITION BY k, d ORDER BY o_orderkey) AS freq
      FROM b)
SELECT o_orderkey, k, CAST(freq AS BIGINT) AS freq_in_window, round(1.0 / freq, 4) AS novelty_score FROM f
""")
def q20_skewed(spark, sf):
    o = T(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("o_custkey")).alias("k"),
        "o_orderdate")
    f = novelty.novelty_score(novelty.trailing_frequency(o, "k", "o_orderdate", "o_orderkey", 1825))
    return f.select("o_orderkey", "k", "freq_in_window", r4("novelty_score").alias("novelty_score"))
